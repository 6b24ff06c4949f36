"""Runs a send policy (see ``triggers``) over keys, cut into slices where a key is hot.

Rows stream through ``mapInArrow`` in key order; a task holds one Arrow batch and the last
sent row. A slice of a hot key is first reduced to the rows that could be its first accepted
one and where each of them leads; these summaries are chained per key, which gives every
slice the row it starts from, and the slices then run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .timeline import SLICE, Timeline
from .triggers import Policy, ends, key_starts, sent

SEED = "_seed"
OUTPUT = "event_type string, prev_t_us bigint"
SUMMARY = "_starts binary, _ends binary"


def pack(batch: pa.RecordBatch) -> bytes:
    """Rows as bytes that a column or a stream's state can hold."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: Sequence[str]) -> bool:
    """Whether the last row of ``a`` and the first one of ``b`` have the same key."""
    return all(a.column(k)[len(a) - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def _joined(first: pa.RecordBatch, second: pa.RecordBatch) -> pa.RecordBatch:
    return pa.Table.from_batches([first, second.cast(first.schema)]).combine_chunks().to_batches()[0]


def attempts(policy: Policy, parts: Sequence[str], passed: Sequence[str], schema: pa.Schema,
             seeded: bool):
    """A ``mapInArrow`` function: sorted rows to attempted rows with event and last send."""
    time = policy.due.columns[0]
    held = list(dict.fromkeys([*parts, *policy.inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in batches:
            if not len(batch):
                continue
            work = batch.select(held)
            seed = (batch.column(SEED).to_numpy(zero_copy_only=False).astype(bool)
                    if seeded else np.zeros(len(batch), bool))
            shift = 0
            if carry is not None and _same_key(carry, work, parts):
                work = _joined(carry, work)
                seed, shift = np.append(True, seed), 1
            begin = key_starts(work, parts)
            rows, rank, then, last = sent(policy, work, begin, seed)
            # A key that goes on without an accepted row yet has no state to carry.
            carry = work.slice(last, 1) if last >= 0 else None
            taken = batch.select(list(passed)).take(pa.array(rows - shift))
            names = np.array([*policy.events, policy.first], dtype=object)
            before = work.column(time).take(pa.array(np.maximum(then, 0)))
            before = pa.array(before.to_numpy(zero_copy_only=False), mask=then < 0)
            arrays = [*taken.columns, pa.array(names[rank], pa.string()), before]
            yield pa.RecordBatch.from_arrays(
                [x.cast(f.type) for x, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def _summaries(policy: Policy, parts: Sequence[str], schema: pa.Schema):
    """Slices, each held whole, to one row each."""
    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        inputs = table.select(policy.inputs)
        start, end = ends(policy, inputs)
        last, place = np.unique(end, return_inverse=True)
        starts = inputs.take(pa.array(start)).append_column(
            "_end", pa.array(place.astype(np.int32)))
        values = [table.column(p).slice(0, 1) for p in parts]
        values += [pa.array([pack(starts)], pa.binary()),
                   pa.array([pack(inputs.take(pa.array(last)))], pa.binary())]
        return pa.RecordBatch.from_arrays(
            [x.cast(f.type) for x, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            begin = key_starts(batch, parts).tolist()
            for a, b in zip(begin, [*begin[1:], len(batch)], strict=True):
                part = batch.slice(a, b - a)
                if held and not (a == 0 and _same_key(held[-1], part, parts)):
                    yield row(held)
                    held = []
                held.append(part)
        if held:
            yield row(held)

    return run


def _first_fired(policy: Policy, state: pa.RecordBatch, starts: pa.RecordBatch) -> int:
    """The first of the rows that fires against the state, by growing stretches; -1 if none."""
    at, size = 0, 64
    while at < len(starts):
        some = _joined(state, starts.slice(at, size))
        views = policy.views(some)
        n = len(some)
        fired = policy.which([tuple(x[1:] for x in v) for v in views],
                             [tuple(np.repeat(x[:1], n - 1) for x in v) for v in views])
        hit = np.flatnonzero(fired >= 0)
        if len(hit):
            return at + int(hit[0])
        at, size = at + size, 2 * size
    return -1


def _chain(policy: Policy, keys: Sequence[str], parts: Sequence[str], schema: pa.Schema):
    """Summaries in order to the row that each slice starts from (none: no row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = before = None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                if before is None or not _same_key(before, row, keys):
                    state = None
                before = row
                if state is not None:
                    arrays = [*[row.column(p) for p in parts], *state.columns]
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(f.type) for x, f in zip(arrays, schema, strict=True)],
                        schema=schema)
                starts = unpack(row.column("_starts")[0].as_py())
                last = unpack(row.column("_ends")[0].as_py())
                if not len(starts):
                    continue
                goes = starts.column("_end").to_numpy()
                starts = starts.select(policy.inputs)
                at = 0 if state is None else _first_fired(policy, state, starts)
                if at >= 0:
                    state = last.slice(int(goes[at]), 1)

    return run


def _schema(df: DataFrame, columns: Sequence[str], ddl: str = "") -> StructType:
    return StructType([df.schema[c] for c in columns]
                      + (list(StructType.fromDDL(ddl)) if ddl else []))


def run_policy(timeline: Timeline, policy: Policy, keep: Sequence[str]) -> DataFrame:
    """The attempted rows of a time line: keys, order, ``keep``, event and last send."""
    parts = timeline.parts
    columns = list(dict.fromkeys([*policy.inputs, *keep]))
    passed = list(dict.fromkeys([*timeline.keys, *timeline.order, *keep]))
    rows = timeline.sorted_parts(columns)
    schema = _schema(rows, passed, OUTPUT)
    arrow = to_arrow_schema(schema)
    if not timeline.split:
        return timeline.mark(rows.mapInArrow(attempts(policy, parts, passed, arrow, False), schema))

    summary = _schema(rows, parts, SUMMARY)
    entry = _schema(rows, [*parts, *policy.inputs])
    starts = (
        rows.where(F.col(SLICE) >= 0)
        .mapInArrow(_summaries(policy, parts, to_arrow_schema(summary)), summary)
        .repartition(*timeline.keys).sortWithinPartitions(*timeline.keys, SLICE)
        .mapInArrow(_chain(policy, timeline.keys, parts, to_arrow_schema(entry)), entry))
    both = timeline.wide(columns).withColumn(SEED, F.lit(False)).unionByName(
        starts.withColumn(SEED, F.lit(True)), allowMissingColumns=True)
    seeded = (
        timeline.deal(both, parts)
        .sortWithinPartitions(*parts, F.desc(SEED), *timeline.order))
    return seeded.mapInArrow(attempts(policy, parts, passed, arrow, True), schema)
