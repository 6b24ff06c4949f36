"""Hard negatives by an inverted multi-index with certified windows.

Vectors are whole numbers and a score is an inner product. Each half of the dimensions has a
codebook; a pair of codes is a cell. With ``c`` the code's centre and ``R`` the largest
distance from it of any row with that code, the half score of a row cannot exceed
``q . c + |q| R``: the two halves' bounds add up to the bound of a cell. A heap visits the
cells of an anchor by falling bound (multi-sequence order). It first takes cells until they
hold enough rows for a first answer; the least score of that answer then certifies the rest:
only cells whose bound reaches it can still change the answer, and exactly those are visited.

On Spark the index is a table of blocks of about a thousand rows in cell order, anchors go
in packs, and a visit is a row (pack, block). Four visits answer all anchors: first and
certified positives, then, with their scores as windows, first and certified negatives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep
from fieldstream.llm.vectors import fit_sample, lloyd, matrix, nearest, one_per_id, usable

SCALE = 256
FIT_ROWS = 16_384     # rows that the codebooks are fitted on; all rows are indexed
ROWS_A_CELL = 256     # aimed at; a half codebook has at most MOST_CODES codes
MOST_CODES = 256
BLOCK_ROWS = 1024
ROWS_A_PART = 16_384  # rows of the index, or anchors, that one task puts in order
PACK = 256            # anchors that are scored against a block at once
FIRST_ROWS = 2048     # rows that the first visit of an anchor should see
SLACK = 1e-6          # bounds are floats; scores are whole numbers

BLOCK = ("block long, cells binary, ends binary, ids binary, labels binary, wide boolean, "
         "data binary")
PACK_ROW = ("pack long, anchors binary, anchor_labels binary, wide_anchors boolean, "
            "anchor_data binary")


@dataclass(frozen=True)
class Index:
    """What an anchor needs to order the cells: at most 2 * MOST_CODES centres and radii,
    and the number of rows of each of the (at most MOST_CODES^2) cells."""
    left: np.ndarray
    right: np.ndarray
    radius_left: np.ndarray
    radius_right: np.ndarray
    rows: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds of both half scores by code, and lower bounds."""
        half = self.left.shape[1]
        out = []
        for part, center, radius in ((q[:, :half], self.left, self.radius_left),
                                     (q[:, half:], self.right, self.radius_right)):
            middle = part @ center.T
            reach = np.linalg.norm(part, axis=1)[:, None] * radius
            slack = SLACK * (1 + np.abs(middle) + reach)
            out.append((middle + reach + slack, middle - reach - slack))
        (u, lu), (v, lv) = out
        return u, v, lu, lv


def visit(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all cells by falling ``u[i] + v[j]``: the multi-sequence order."""
    by_u, by_v = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    heap = [(-(u[by_u[0]] + v[by_v[0]]), 0, 0)] if len(u) and len(v) else []
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, int(by_u[a]), int(by_v[b])
        # Each cell is pushed once: along its row always, down a column from the first only.
        if b + 1 < len(v):
            heapq.heappush(heap, (-(u[by_u[a]] + v[by_v[b + 1]]), a, b + 1))
        if b == 0 and a + 1 < len(u):
            heapq.heappush(heap, (-(u[by_u[a + 1]] + v[by_v[0]]), a + 1, 0))


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    y = np.floor(scale * vectors)
    if y.size and np.abs(y).max() >= 2.0 ** 62:
        raise OverflowError("an entry is too large for whole numbers of 64 bits")
    return y.astype(np.int64)


def _store(y: np.ndarray) -> tuple[bool, bytes]:
    wide = bool(y.size and np.abs(y).max() >= 1 << 15)
    return wide, y.astype("<i8" if wide else "<i2").tobytes()


def _load(wide: bool, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if wide else "<i2").reshape(rows, -1).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles while all sums stay below 2^53, else by integers."""
    top = a.shape[1] * max(1, int(np.abs(a).max())) * max(1, int(np.abs(b).max()))
    if 100 * top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if 100 * top < 1 << 63:
        return a @ b.T
    raise OverflowError("a score times 100 does not fit 64 bits")


def _fit(rows: DataFrame, total: int, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    some = np.floor(scale * fit_sample(rows, total, "id", "v", FIT_ROWS))
    codes = int(np.clip(np.ceil(np.sqrt(total / ROWS_A_CELL)), 1, MOST_CODES))
    half = (dims + 1) // 2
    if not len(some):  # a sample by hash of very few rows may be empty
        some = np.zeros((1, dims))
    return lloyd(some[:, :half], codes), lloyd(some[:, half:], codes, seed=8)


def _coded(rows: DataFrame, left: np.ndarray, right: np.ndarray, scale: int) -> DataFrame:
    """(id, label, anchor, i, j, r1, r2, v): the cell of each row, and how far it is from
    both centres."""
    half = left.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((left, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = shared.value
        for batch in batches:
            y = whole(matrix(batch.column(3)), scale).astype(np.float64)
            i, j = nearest(y[:, :half], first), nearest(y[:, half:], second)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(np.linalg.norm(y[:, :half] - first[i], axis=1)),
                 pa.array(np.linalg.norm(y[:, half:] - second[j], axis=1)), batch.column(3)],
                ["id", "label", "anchor", "i", "j", "r1", "r2", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "label", "anchor", "v").mapInArrow(
        K.tidy(run), f"id long, label long, anchor boolean, i int, j int, r1 double, "
                     f"r2 double, v {kind}")


def _in_order(coded: DataFrame, parts: int) -> DataFrame:
    """Rows in cell order; a cell with very many rows is cut by id."""
    order = ["i", "j", "id"]
    return coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Table]]:
    """Tables of ``size`` rows of a sorted partition, with a number that no other one has."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        while rows >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield number, table.slice(0, size).combine_chunks()
            held, rows, number = table.slice(size).to_batches(), rows - size, number + 1
    if rows:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _blocks(coded: DataFrame, parts: int, codes: int, scale: int) -> DataFrame:
    """The index: blocks of rows in cell order, each with its cells and where they end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _grouped(batches, BLOCK_ROWS):
            cell = (table["i"].to_numpy().astype(np.int64) * codes + table["j"].to_numpy())
            last = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
            wide, data = _store(whole(matrix(table["v"].combine_chunks()), scale))
            yield pa.RecordBatch.from_pylist([{
                "block": number, "cells": cell[last].tobytes(),
                "ends": (last + 1).astype(np.int64).tobytes(),
                "ids": table["id"].to_numpy().tobytes(),
                "labels": table["label"].to_numpy().tobytes(), "wide": wide, "data": data}])

    return _in_order(coded, parts).select("id", "label", "i", "j", "v").mapInArrow(
        K.tidy(run), BLOCK)


def _packs(coded: DataFrame, parts: int, scale: int) -> DataFrame:
    """Anchors of like cells side by side, so that those of a pack want the same blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _grouped(batches, PACK):
            wide, data = _store(whole(matrix(table["v"].combine_chunks()), scale))
            yield pa.RecordBatch.from_pylist([{
                "pack": number, "anchors": table["id"].to_numpy().tobytes(),
                "anchor_labels": table["label"].to_numpy().tobytes(),
                "wide_anchors": wide, "anchor_data": data}])

    return _in_order(coded.where("anchor"), parts).select("id", "label", "i", "j", "v").mapInArrow(
        K.tidy(run), PACK_ROW)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each owner's rows the first ``most`` by falling score, then by id."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < most]


class Search:
    """One index, its anchors in packs, and the visits of both."""

    def __init__(self, rows: DataFrame, total: int, dims: int, scale: int, positives: int,
                 negatives: int, low: int, high: int):
        spark = rows.sparkSession
        self.k, self.m, self.low, self.high = positives, negatives, low, high
        left, right = _fit(rows, total, dims, scale)
        self.codes = len(right)
        coded = keep(_coded(rows, left, right, scale), "cells-of-rows")
        by_cell = coded.groupBy("i", "j").agg(
            F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
        held = np.zeros((len(left), len(right)), np.int64)
        reach = np.zeros(len(left)), np.zeros(len(right))
        for r in by_cell:
            held[r["i"], r["j"]] = r["n"]
            reach[0][r["i"]] = max(reach[0][r["i"]], r["r1"])
            reach[1][r["j"]] = max(reach[1][r["j"]], r["r2"])
        self.index = spark.sparkContext.broadcast(Index(left, right, *reach, held))
        anchors = coded.where("anchor").count()
        self.blocks = keep(_blocks(coded, -(-total // ROWS_A_PART), self.codes, scale), "blocks")
        self.packs = keep(_packs(coded, max(1, -(-anchors // ROWS_A_PART)), scale), "packs")
        directory = self.blocks.select("block", "cells").mapInArrow(
            _directory, "cell long, block long")
        self.directory = keep(directory, "directory")

    def _to_blocks(self, wanted: DataFrame, done: DataFrame | None) -> DataFrame:
        """(pack, block) of (pack, cell), without what an earlier visit has seen."""
        cells = self.directory.withColumnRenamed("cell", "__cell")
        out = (wanted.join(cells, F.col("cell") == F.col("__cell"))
               .select("pack", "block").distinct())
        return out if done is None else out.join(done, ["pack", "block"], "left_anti")

    def first_cells(self) -> DataFrame:
        """The cells that each anchor's heap visits until they hold FIRST_ROWS rows."""
        index = self.index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    u, v, _, _ = index.value.bounds(_anchors(row).astype(np.float64))
                    cells: set[int] = set()
                    for a in range(len(u)):
                        seen = 0
                        for _, i, j in visit(u[a], v[a]):
                            if index.value.rows[i, j]:
                                seen += int(index.value.rows[i, j])
                                cells.add(i * v.shape[1] + j)
                            if seen >= FIRST_ROWS:
                                break
                    yield _cells(row["pack"], sorted(cells))

        return self.packs.mapInArrow(K.tidy(run), "pack long, cell long")

    def certified_cells(self, limits: DataFrame) -> DataFrame:
        """The cells that can still change an answer, given ``limits`` of the anchors:
        (pack, anchor, floor, ceiling). A cell counts if its bound reaches the anchor's floor
        and its least score does not lie above the ceiling; the heap, visiting by falling
        bound, would come to just these before it stops. An anchor without a row needs none.
        """
        index = self.index

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    known = {a: (x, y) for a, x, y in zip(
                        row["who"], row["floors"], row["ceilings"])}
                    u, v, lu, lv = index.value.bounds(_anchors(row).astype(np.float64))
                    open_ = np.zeros(index.value.rows.shape, bool)
                    for a, name in enumerate(_numbers(row["anchors"]).tolist()):
                        if name in known:
                            floor, ceiling = known[name]
                            open_ |= ((u[a][:, None] + v[a] >= floor)
                                      & (lu[a][:, None] + lv[a] <= ceiling))
                    i, j = np.nonzero(open_ & (index.value.rows > 0))
                    yield _cells(row["pack"], (i * v.shape[1] + j).tolist())

        gathered = limits.groupBy(F.col("pack").alias("__pack")).agg(
            F.collect_list(F.struct("anchor", "floor", "ceiling")).alias("l"))
        return (self.packs.join(gathered, F.col("pack") == F.col("__pack"))
                .select(*self.packs.columns, F.col("l.anchor").alias("who"),
                        F.col("l.floor").alias("floors"), F.col("l.ceiling").alias("ceilings"))
                .mapInArrow(K.tidy(run), "pack long, cell long"))

    def _meet(self, visits: DataFrame, known: DataFrame) -> DataFrame:
        """Packs beside blocks, each pack with what is known of its anchors (at most PACK
        rows for positives, PACK * positives for negatives)."""
        facts = known.groupBy(F.col("pack").alias("__pack")).agg(
            F.collect_list(F.struct(*[c for c in known.columns if c != "pack"])).alias("known"))
        packs = self.packs.join(facts, F.col("pack") == F.col("__pack"), "left").drop("__pack")
        return (visits.join(packs.withColumnRenamed("pack", "__p"), F.col("pack") == F.col("__p"))
                .drop("__p").join(self.blocks.withColumnRenamed("block", "__b"),
                                  F.col("block") == F.col("__b")).drop("__b"))

    def scan_positives(self, visits: DataFrame, floors: DataFrame) -> DataFrame:
        """(pack, anchor, id, score): of every visited block an anchor's best other rows of
        its label, none below the floor known so far."""
        most = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _dicts(batch):
                    names, ids = _numbers(row["anchors"]), _numbers(row["ids"])
                    s = scores(_anchors(row), _load(row["wide"], row["data"], len(ids)))
                    least = np.full(len(names), np.iinfo(np.int64).min)
                    at = {n: i for i, n in enumerate(names.tolist())}
                    for fact in row["known"] or []:
                        least[at[fact["anchor"]]] = fact["floor"]
                    good = ((_numbers(row["anchor_labels"])[:, None] == _numbers(row["labels"]))
                            & (names[:, None] != ids) & (s >= least[:, None]))
                    a, r = np.nonzero(good)
                    top = _best(a, s[a, r], ids[r], most)
                    a, r = a[top], r[top]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), row["pack"])), pa.array(names[a]),
                         pa.array(ids[r]), pa.array(s[a, r])],
                        ["pack", "anchor", "id", "score"])

        return self._meet(visits, floors).mapInArrow(
            K.tidy(run), "pack long, anchor long, id long, score long")

    def scan_negatives(self, visits: DataFrame, windows: DataFrame) -> DataFrame:
        """(pack, anchor, positive, id, score): of every visited block the best rows of other
        labels in each positive's window, none below the floor known so far."""
        most, low, high = self.m, self.low, self.high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _dicts(batch):
                    names, ids = _numbers(row["anchors"]), _numbers(row["ids"])
                    s = scores(_anchors(row), _load(row["wide"], row["data"], len(ids)))
                    at = {n: i for i, n in enumerate(names.tolist())}
                    facts = row["known"] or []
                    a = np.array([at[f["anchor"]] for f in facts], np.int64)
                    positive = np.array([f["positive"] for f in facts], np.int64)
                    ps = np.array([f["score"] for f in facts], np.int64)[:, None]
                    least = np.array([f["floor"] for f in facts], np.int64)[:, None]
                    seen = s[a]
                    other = _numbers(row["anchor_labels"])[a][:, None] != _numbers(row["labels"])
                    f, r = np.nonzero(other & (high * seen <= high * ps)
                                      & (high * seen >= low * ps) & (seen >= least))
                    top = _best(f, seen[f, r], ids[r], most)
                    f, r = f[top], r[top]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(f), row["pack"])), pa.array(names[a[f]]),
                         pa.array(positive[f]), pa.array(ids[r]), pa.array(seen[f, r])],
                        ["pack", "anchor", "positive", "id", "score"])

        return self._meet(visits, windows).mapInArrow(
            K.tidy(run), "pack long, anchor long, positive long, id long, score long")

    def positives(self) -> tuple[DataFrame, DataFrame]:
        """(pack, anchor, id, score, rank) of all anchors, and the first visit's blocks."""
        none = self.packs.sparkSession.createDataFrame([], "pack long, anchor long, floor long")
        start = keep(self._to_blocks(self.first_cells(), None), "first-visit")
        got = keep(self.scan_positives(start, none), "first-positives")
        full = _ranked(got, ["pack", "anchor"], self.k)
        floors = full.groupBy("pack", "anchor").agg(
            F.when(F.count("*") == self.k, F.min("score"))
            .otherwise(F.lit(-(1 << 63))).alias("floor"))
        names = self.packs.select("pack", "anchors").mapInArrow(_names, "pack long, anchor long")
        floors = keep(names.join(floors, ["pack", "anchor"], "left").select(
            "pack", "anchor", F.coalesce("floor", F.lit(-(1 << 63))).alias("floor")), "floors")
        limits = floors.withColumn("ceiling", F.lit((1 << 63) - 1))
        rest = keep(self._to_blocks(self.certified_cells(limits), start), "certified-visit")
        more = self.scan_positives(rest, floors)
        return keep(_ranked(got.unionByName(more), ["pack", "anchor"], self.k), "positives"), start

    def negatives(self) -> DataFrame:
        """(anchor, positive, rank, id, score, positive_score)."""
        best, start = self.positives()
        floor = F.ceil(F.col("score").cast("decimal(20,0)") * self.low / self.high).cast("long")
        windows = best.where("score >= 0").select(
            "pack", "anchor", F.col("id").alias("positive"), "score", floor.alias("floor"))
        start = start.join(windows.select("pack").distinct(), "pack", "left_semi")
        got = keep(self.scan_negatives(start, windows), "first-negatives")
        each = ["pack", "anchor", "positive"]
        full = _ranked(got, each, self.m).groupBy(*each).agg(
            F.when(F.count("*") == self.m, F.min("score")).alias("known"))
        tighter = keep(windows.join(full, each, "left").select(
            *each, "score", F.greatest("floor", "known").alias("floor")), "windows")
        limits = tighter.groupBy("pack", "anchor").agg(
            F.min("floor").alias("floor"), F.max("score").alias("ceiling"))
        rest = keep(self._to_blocks(self.certified_cells(limits), start), "certified-negatives")
        more = self.scan_negatives(rest, tighter)
        found = _ranked(got.unionByName(more), each, self.m)
        return found.join(best.select(
            "pack", "anchor", F.col("id").alias("positive"),
            F.col("score").alias("positive_score")), each)


def _anchors(row: dict) -> np.ndarray:
    return _load(row["wide_anchors"], row["anchor_data"], len(row["anchors"]) // 8)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, so that only one block is unpacked at once."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


def _cells(pack: int, cells: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([pack] * len(cells), pa.int64()), pa.array(cells, pa.int64())],
        ["pack", "cell"])


def _directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = _numbers(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held), pa.array(np.full(len(held), number))], ["cell", "block"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = _numbers(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), pack)), pa.array(held)], ["pack", "anchor"])


def _ranked(rows: DataFrame, each: list[str], most: int) -> DataFrame:
    best = Window.partitionBy(*each).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id",
         vector_col: str = "embedding", label_col: str = "label", positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """The hardest negatives of each anchor and positive; exact, whatever the codebooks.

    A component x counts as floor(scale * x). An anchor's positives are its ``positives``
    best other rows of the same label; each gets the ``negatives`` best rows of other labels
    with ``low * positive_score <= high * negative_score <= high * positive_score``. Higher
    scores come first, then smaller ids. A positive with a negative score has no such rows.

    Rows without an id, a label or a vector, with an empty vector, with null or non-finite
    components, or of another than the table's most frequent length take no part. Rows that
    share an id count as one, the one with the least label, then vector. An empty table gives
    no rows; other columns are not read. Ids are long. Components and scores that 64 bits
    cannot hold raise an error.
    """
    spark = rows.sparkSession
    slim, dims, total = usable(rows.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("v"))
        .where("id is not null"), "v")
    layout = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    if not total:
        return spark.createDataFrame([], layout)
    search = Search(one_per_id(slim, "id", ["label", "v"]), total, dims, scale, positives,
                    negatives, low, high)
    return search.negatives().select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
        F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
