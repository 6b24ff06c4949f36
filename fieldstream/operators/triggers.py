"""Decisions against the last row that was sent, on whole columns.

A row is sent when a *trigger* fires between it and the last sent row. No window frame can
say that, but the row that follows a given one can be found for all rows at once: every
trigger computes, for each row, the first later row it fires on (``after``), and the least of
these is the row's pointer. Following the pointers from a start gives what is sent; following
them for all rows by doubling (``ends``) gives where a stretch of rows leads from any start.

Rows that were not accepted (a failed send) are never a start: pointers run between accepted
rows only, and the others are then compared with the last accepted one before them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

View = tuple[np.ndarray, ...]


def run_ends(codes: np.ndarray) -> np.ndarray:
    """For each row the first later row with another code (the length if none)."""
    edge = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    return edge[np.searchsorted(edge, np.arange(len(codes)), "right")]


def first_apart(v: np.ndarray, least: float, falls: bool = True) -> np.ndarray:
    """For each row the first later row that lies ``least`` or more above (with ``falls``
    also below) it; the length if none. NaN is never apart from anything.

    Least and greatest values of stretches of 1, 2, 4, ... rows are tabled; each row then
    steps over the longest quiet stretches, the longest first.
    """
    n = len(v)
    real = v.dtype.kind == "f"
    high = np.where(np.isnan(v), -np.inf, v) if real else v
    low = np.where(np.isnan(v), np.inf, v) if real else v
    tables = [(high, low)]
    while 2 << len(tables) - 1 <= n:
        s = 1 << len(tables) - 1
        high, low = tables[-1]
        tables.append((np.maximum(high[:-s], high[s:]),
                       np.minimum(low[:-s], low[s:]) if falls else low[:-s]))
    at = np.arange(1, n + 1)
    with np.errstate(invalid="ignore"):
        for k in range(len(tables) - 1, -1, -1):
            s = 1 << k
            fits = at + s <= n
            p = np.minimum(at, n - s)
            apart = tables[k][0][p] - v >= least
            if falls:
                apart |= v - tables[k][1][p] >= least
            at = at + np.where(fits & ~apart, s, 0)
    return at


def take(view: View, at: np.ndarray) -> View:
    return tuple(x[at] for x in view)


class Trigger:
    """One reason to send, named ``event``, over some columns of the rows."""

    event: str
    columns: Sequence[str]

    def view(self, batch: pa.RecordBatch) -> View:
        """What is compared, one value per row."""
        raise NotImplementedError

    def after(self, view: View) -> np.ndarray:
        """For each row the first later row that it fires on, or the length."""
        raise NotImplementedError

    def fires(self, now: View, then: View) -> np.ndarray:
        raise NotImplementedError


def _floats(column: pa.Array) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False)


class Changed(Trigger):
    """A value appears, disappears, moves to or from zero, or by ``delta`` or more.

    Strings that are numbers count as such; others change when they differ.
    """

    def __init__(self, column: str, delta: float, event: str):
        self.columns, self.delta, self.event = [column], delta, event

    def view(self, batch):
        column = batch.column(self.columns[0])
        null = column.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            coded = column.dictionary_encode()
            number, plain = [], []
            for text in coded.dictionary.to_pylist():
                try:
                    number.append(float(text))
                    plain.append(False)
                except ValueError:
                    number.append(np.nan)
                    plain.append(True)
            index = coded.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            value = np.append(number, 0.0)[index]
            kind = np.where(np.append(plain, False)[index], 3 + index, np.where(value == 0, 1, 2))
        else:
            value = _floats(column)
            kind = np.where(value == 0, 1, 2).astype(np.int64)
        kind[null] = 0
        value = np.where(null, np.nan, value)
        return kind, value

    def after(self, view):
        kind, value = view
        return np.minimum(run_ends(kind), first_apart(value, self.delta))

    def fires(self, now, then):
        with np.errstate(invalid="ignore"):
            return (now[0] != then[0]) | (np.abs(now[1] - then[1]) >= self.delta)


class Moved(Trigger):
    """A value, null counting as zero, moves by ``delta`` or more."""

    def __init__(self, column: str, delta: float, event: str):
        self.columns, self.delta, self.event = [column], delta, event

    def view(self, batch):
        return (_floats(batch.column(self.columns[0]).fill_null(0)),)

    def after(self, view):
        return first_apart(view[0], self.delta)

    def fires(self, now, then):
        return np.abs(now[0] - then[0]) >= self.delta


class Whole(Trigger):
    """A value rounded to whole numbers (half to even) is another one, or null and not."""

    def __init__(self, column: str, event: str):
        self.columns, self.event = [column], event

    def view(self, batch):
        column = batch.column(self.columns[0])
        rounded = np.rint(_floats(column))
        null = column.is_null().to_numpy(zero_copy_only=False)
        return (np.where(null, -np.inf, rounded),)

    def after(self, view):
        return run_ends(view[0])

    def fires(self, now, then):
        return now[0] != then[0]


class Raised(Trigger):
    """A code changes to another one that is not zero (null counts as zero)."""

    def __init__(self, column: str, event: str):
        self.columns, self.event = [column], event

    def view(self, batch):
        column = pc.cast(batch.column(self.columns[0]), pa.int64()).fill_null(0)
        return (column.to_numpy(zero_copy_only=False),)

    def after(self, view):
        code, n = view[0], len(view[0])
        raised = np.flatnonzero(code)
        # The first raised row after each row, and after it the first one with another code.
        place = np.append(raised, n)
        other = place[np.append(run_ends(code[raised]), len(raised))]
        k = np.searchsorted(raised, np.arange(n), "right")
        same = np.append(code[raised], 0)[k] == code
        return np.where(same & (k < len(raised)), other[k], place[k])

    def fires(self, now, then):
        return (now[0] != then[0]) & (now[0] != 0)


class Due(Trigger):
    """So many microseconds have passed."""

    def __init__(self, time: str, micros: int, event: str):
        self.columns, self.micros, self.event = [time], micros, event

    def view(self, batch):
        return (batch.column(self.columns[0]).to_numpy(zero_copy_only=False),)

    def after(self, view):
        return first_apart(view[0], self.micros, falls=False)

    def fires(self, now, then):
        return now[0] - then[0] >= self.micros


class Policy:
    """Triggers by rank (the first that fires names the event), and the first row's event.

    ``due`` is the trigger that fires on any row once enough time has passed, so a row's
    pointer never leads beyond the first row after that time.
    """

    def __init__(self, first: str, triggers: Sequence[Trigger], due: Due, ok: str | None = None):
        self.first, self.triggers, self.due, self.ok = first, [*triggers, due], due, ok
        self.events = [t.event for t in self.triggers]
        self.inputs = list(dict.fromkeys(
            [*due.columns, *([ok] if ok else []), *(c for t in triggers for c in t.columns)]))

    def accepted(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.ok is None:
            return np.ones(len(batch), bool)
        return batch.column(self.ok).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)

    def views(self, batch: pa.RecordBatch) -> list[View]:
        return [t.view(batch) for t in self.triggers]

    def pointers(self, views: list[View], stop: np.ndarray) -> np.ndarray:
        """For each row the next one sent after it, if that lies before ``stop``; else the
        number of rows."""
        n = len(stop)
        out = stop.copy()
        for trigger, view in zip(self.triggers, views, strict=True):
            out = np.minimum(out, trigger.after(view))
        return np.where(out < stop, out, n)

    def which(self, now: list[View], then: list[View]) -> np.ndarray:
        """The rank of the first trigger that fires, -1 if none does."""
        out = np.full(len(now[0][0]), -1)
        for rank in range(len(self.triggers) - 1, -1, -1):
            out[self.triggers[rank].fires(now[rank], then[rank])] = rank
        return out


def key_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Rows where a key begins that is not the key of the row before."""
    fresh = np.zeros(len(batch), bool)
    if len(batch):
        fresh[0] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(
            zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(fresh)


def sent(policy: Policy, batch: pa.RecordBatch, begin: np.ndarray, seed: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of rows in order, with each key's first row in ``begin``: the rows that are attempted,
    the rank of their event (-1: the first of its key), the row each was compared with (-1:
    none), and the last accepted row of the last key (-1: none).

    ``seed`` marks rows that only bring a state along; they come first in their key.
    """
    n = len(batch)
    end = np.append(begin[1:], n)
    of = np.repeat(np.arange(len(begin)), end - begin)
    taken = policy.accepted(batch) | seed
    rows = np.flatnonzero(taken)
    views = policy.views(batch)
    stop = np.searchsorted(rows, end[of[rows]])
    hop = policy.pointers([take(v, rows) for v in views], stop).tolist()
    chosen = bytearray(len(rows))
    for at in np.flatnonzero(np.diff(of[rows], prepend=-1)).tolist():
        while at < len(hop):
            chosen[at] = 1
            at = hop[at]
    states = rows[np.frombuffer(chosen, np.uint8).astype(bool)] if len(rows) else rows
    maybe = ~taken
    maybe[states] = True
    look = np.flatnonzero(maybe & ~seed)
    k = np.searchsorted(states, look, "left") - 1
    then = np.append(states, -1)[k]
    then = np.where(then >= begin[of[look]], then, -1)
    rank = policy.which([take(v, look) for v in views], [take(v, then) for v in views])
    out = (rank >= 0) | (then < 0)
    rank[then < 0] = -1
    last = int(states[-1]) if len(states) and states[-1] >= begin[-1] else -1
    return look[out], rank[out], then[out], last


def ends(policy: Policy, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where a stretch of one key's rows leads: the rows that can be the first accepted one
    for some start, and for each of these the last accepted row.

    Every accepted row is due once the policy's time has passed since the start, so the
    candidates end with the first accepted row at or after that time.
    """
    rows = np.flatnonzero(policy.accepted(batch))
    if not len(rows):
        return rows, rows
    views = [take(v, rows) for v in policy.views(batch)]
    n = len(rows)
    nxt = policy.pointers(views, np.full(n, n))
    root = np.where(nxt < n, nxt, np.arange(n))
    while True:  # pointer jumping: path lengths halve each time
        far = root[root]
        if (far == root).all():
            break
        root = far
    time = policy.due.view(batch)[0]
    upto = int(np.searchsorted(time[rows], time[0] + policy.due.micros, "left")) + 1
    return rows[:upto], rows[root[:upto]]
