"""Pointers of triggers against a loop over pairs, reject sides, and lines in chunks."""

import numpy as np
import pyarrow as pa
import pytest

from fieldstream.operators import triggers as t
from fieldstream.sinks import rejects
from fieldstream.sources import captures

NAN, INF = float("nan"), float("inf")


def column(kind, n=120, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "text":
        return pa.array(rng.choice(["1", "1.0", "0", "-3", "ab", "b", None], n).tolist(), pa.string())
    pool = {"int": [None, 0, 1, 2, 5, -4], "float": [None, 0.0, 0.1, 0.3, NAN, INF, -INF, 2.5]}
    values = [pool[kind][i] for i in rng.integers(0, len(pool[kind]), n)]
    return pa.array(values, pa.int64() if kind == "int" else pa.float64())


def by_pairs(trigger, batch):
    view, n = trigger.view(batch), len(batch)
    out = []
    for i in range(n):
        later = np.arange(i + 1, n)
        hit = trigger.fires(t.take(view, later), t.take(view, np.full(len(later), i)))
        out.append(int(later[hit][0]) if hit.any() else n)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("make, kind", [
    (lambda: t.Changed("v", 2.0, "x"), "int"), (lambda: t.Changed("v", 0.2, "x"), "float"),
    (lambda: t.Changed("v", 0.0, "x"), "int"), (lambda: t.Changed("v", 1.5, "x"), "text"),
    (lambda: t.Moved("v", 3.0, "x"), "int"), (lambda: t.Whole("v", "x"), "float"),
    (lambda: t.Raised("v", "x"), "int")])
def test_pointers_are_the_first_row_that_fires(make, kind, seed):
    trigger = make()
    batch = pa.RecordBatch.from_arrays([column(kind, seed=seed)], ["v"])
    if isinstance(trigger, t.Whole):  # an endless charge has no whole number
        batch = pa.RecordBatch.from_arrays(
            [pa.array([None if x in (None, NAN, INF, -INF) or x != x else x
                       for x in batch.column(0).to_pylist()], pa.float64())], ["v"])
    assert trigger.after(trigger.view(batch)).tolist() == by_pairs(trigger, batch)


def test_due_times():
    batch = pa.RecordBatch.from_arrays([pa.array(np.sort(
        np.random.default_rng(1).integers(0, 400, 150)))], ["v"])
    trigger = t.Due("v", 25, "x")
    assert trigger.after(trigger.view(batch)).tolist() == by_pairs(trigger, batch)


@pytest.mark.parametrize("values", [[], [3.0]])
def test_no_rows_and_one(values):
    v = np.array(values)
    assert t.first_apart(v, 1.0).tolist() == [1] * len(v)
    assert t.run_ends(v).tolist() == [1] * len(v)


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    base = str(tmp_path / "sides")
    shape = "i bigint, reject_reason string"
    first = spark.createDataFrame([(1, None), (2, "crc"), (3, None)], shape)
    second = spark.createDataFrame([(4, "short"), (5, None)], shape)
    for df, number in ((first, 0), (second, 1), (first, 0), (second, 1)):
        rejects.write_sides(df, base, number)
    def ids(side):
        return sorted((r["i"], r["batch"]) for r in rejects.read_side(
            spark, base, side, shape).collect())
    assert ids("rejects") == [(2, 0), (4, 1)]
    assert ids("events") == [(1, 0), (3, 0), (5, 1)]


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("limit", [None, 5])
def test_lines_in_chunks_of_any_size(spark, size, limit):
    logs = {1: "one\r\n\n  twö \nthree".encode(), 2: b"\xff\n" + "é€\n".encode() * 9, 3: b"", 4: b"x"}
    rows = [(k, i, raw[i:i + size]) for k, raw in logs.items() for i in range(0, len(raw), size)]
    rows.append((1, -1, None))
    df = spark.createDataFrame(rows, "k int, at int, raw binary").repartition(4)
    got = captures.reassembled_lines(df, ["k"], ["at"], limit=limit)
    want = [(1, 0, "one"), (1, 2, "twö"), *[(2, n, "é€") for n in range(1, 10)]]
    assert sorted(tuple(r) for r in got.collect()) == want
