"""Sequential per-key folds, for decisions that depend on the previous *output*.

No window frame can say "compare with the last row that was emitted". Rows are shuffled
by key, sorted within the partition and streamed through ``mapInArrow``; the state is
carried across Arrow batches, so a task holds one batch and one state.

A hot key is cut into slices (see ``timeline``). The state a slice starts from is found
exactly, without running the slices one after another: every slice is first reduced to
a summary that maps any possible start to the state it ends with, the summaries of a
key are chained, and the slices then run in parallel from their true starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .timeline import SLICE, Timeline

ENTRY = "_entry"


class Fold:
    """A step function and the way to summarise a run of rows.

    ``inputs`` are the columns a row tuple holds, in order. States must survive JSON.
    """

    inputs: Sequence[str] = ()
    output: str = ""                    # DDL of the columns added to each kept row

    def initial(self):
        return None

    def step(self, state, row):
        """(state after the row, output tuple or None to drop the row)."""
        raise NotImplementedError

    def summarise(self, rows):
        """Summary of a slice, for ``chain``."""
        raise NotImplementedError

    def chain(self, state, summary):
        """State after a slice that starts in ``state``."""
        raise NotImplementedError


class FiniteState(Fold):
    """Folds whose state is one of few small numbers: the summary is the whole table."""

    states: Sequence[int] = ()

    def initial(self):
        return self.states[0]

    def summarise(self, rows):
        ends = []
        for state in self.states:
            for row in rows:
                state, _ = self.step(state, row)
            ends.append(state)
        return ends

    def chain(self, state, summary):
        return summary[list(self.states).index(state)]


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple]:
    return list(zip(*[batch.column(n).to_pylist() for n in names], strict=True))


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]):
    """(key, whether it continues the run before, batch, start, stop) of equal-key runs."""
    last = None
    for batch in batches:
        ids = _columns(batch, keys)
        start = 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or ids[i] != ids[start]:
                yield ids[start], ids[start] == last, batch, start, i
                last = ids[start]
                start = i


def _state(text: str):
    value = json.loads(text)
    return tuple(value) if isinstance(value, list) else value


def _runner(fold: Fold, parts: Sequence[str], passed: Sequence[str], schema: pa.Schema,
            seeded: bool):
    def assemble(batch, keep, produced):
        taken = batch.select(list(passed)).take(pa.array(keep, type=pa.int64()))
        added = list(zip(*produced, strict=True)) or [()] * (len(schema) - len(passed))
        arrays = list(taken.columns) + [
            pa.array(values, type=field.type)
            for values, field in zip(added, list(schema)[len(passed):], strict=True)]
        return pa.RecordBatch.from_arrays(
            [a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def run(batches):
        state, current, rows, entries = None, None, [], None
        keep, produced = [], []
        for _key, continued, batch, start, stop in _runs(batches, parts):
            if batch is not current:
                if current is not None:
                    yield assemble(current, keep, produced)
                current, rows = batch, _columns(batch, fold.inputs)
                entries = batch.column(ENTRY).to_pylist() if seeded else None
                keep, produced = [], []
            if not continued:
                state = fold.initial()
            for i in range(start, stop):
                if seeded and entries[i] is not None:
                    state = _state(entries[i])
                    continue
                state, result = fold.step(state, rows[i])
                if result is not None:
                    keep.append(i)
                    produced.append(result)
        if current is not None:
            yield assemble(current, keep, produced)

    return run


def _summariser(fold: Fold, parts: Sequence[str], schema: pa.Schema):
    def record(key, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([v], type=f.type) for v, f in
             zip([*key, json.dumps(fold.summarise(rows))], schema, strict=True)], schema=schema)

    def run(batches):
        rows, current = [], None
        for key, continued, batch, start, stop in _runs(batches, parts):
            if not continued:
                if current is not None:
                    yield record(current, rows)
                rows, current = [], key
            rows.extend(_columns(batch.slice(start, stop - start), fold.inputs))
        if current is not None:
            yield record(current, rows)

    return run


def _chainer(fold: Fold, keys: Sequence[str], parts: Sequence[str], schema: pa.Schema):
    def run(batches):
        state = None
        for _key, continued, batch, start, stop in _runs(batches, keys):
            if not continued:
                state = fold.initial()
            part = batch.slice(start, stop - start)
            entries = []
            for summary in part.column("_summary").to_pylist():
                entries.append(None if state is None else json.dumps(state))
                state = fold.chain(state, json.loads(summary))
            arrays = [*part.select(list(parts)).columns, pa.array(entries, type=pa.string())]
            yield pa.RecordBatch.from_arrays(
                [a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    return run


def _schema(df: DataFrame, columns: Sequence[str], ddl: str) -> StructType:
    return StructType([df.schema[c] for c in columns] + list(StructType.fromDDL(ddl)))


def run_fold(timeline: Timeline, fold: Fold, keep: Sequence[str]) -> DataFrame:
    """Run ``fold`` over the timeline; rows with an output keep the columns in ``keep``."""
    parts = timeline.parts
    columns = [*fold.inputs, *keep]
    passed = list(dict.fromkeys([*timeline.keys, *timeline.order, *keep]))
    rows = timeline.sorted_parts(columns)
    schema = _schema(rows, passed, fold.output)
    arrow = to_arrow_schema(schema)
    if not timeline.split:
        return timeline.mark(rows.mapInArrow(_runner(fold, parts, passed, arrow, False), schema))

    summary = _schema(rows, parts, "_summary string")
    entry = _schema(rows, parts, f"{ENTRY} string")
    entries = (
        timeline.sorted_parts(fold.inputs).where(F.col(SLICE) >= 0)
        .mapInArrow(_summariser(fold, parts, to_arrow_schema(summary)), summary)
        .repartition(*timeline.keys).sortWithinPartitions(*timeline.keys, SLICE)
        .mapInArrow(_chainer(fold, timeline.keys, parts, to_arrow_schema(entry)), entry)
        .where(F.col(ENTRY).isNotNull())
    )
    # A seed row carries a slice's start; its order columns are NULL, so it sorts first.
    both = timeline.wide(columns).withColumn(ENTRY, F.lit(None).cast("string")).unionByName(
        entries, allowMissingColumns=True)
    seeded = (
        timeline.deal(both, parts)
        .sortWithinPartitions(*parts, *timeline.order)
    )
    return seeded.mapInArrow(_runner(fold, parts, passed, arrow, True), schema)
