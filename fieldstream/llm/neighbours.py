"""Approximate nearest neighbours by lists and an adaptive dimension scan.

Every vector is turned by one random rotation and filed in the list of its nearest centre.
A list is stored as blocks whose rotated vectors lie in column blocks of 16 dimensions. To
search a block, the first column block gives partial distances of all its rows to the
queries; after a rotation a part of ``t`` of ``D`` dimensions estimates the whole, and a row
is abandoned as soon as ``partial > t / D * (1 + e / sqrt(t))^2 * limit`` (the test that the
true distance is above the query's limit, passed wrongly with a chance that falls with
``e``). Later column blocks are read for the rest only. What is left gets its exact distance
from the original vectors.

A query first scans the lists around it, which gives the limit: its k-th distance so far.
Then the number of rows within the limit is estimated for every list from the list's size
and spread, and the query scans the best lists until those left out should hold less than
``miss`` of all such rows. How many lists that are is thus a matter of the data, not a
parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep
from fieldstream.llm.vectors import fit_sample, lloyd, matrix, nearest, one_per_id, usable

FIT_ROWS = 32_768    # rows that the centres are fitted on; all rows are indexed
MOST_LISTS = 1024
COLUMNS = 16         # dimensions of a column block
BLOCK_ROWS = 512
ROWS_A_PART = 4096   # rows of a list that one join key stands for
PACK = 128           # queries that are compared with a block at once
FIRST_ROWS = 64      # rows a query's first lists should hold, per neighbour wanted
E0 = 2.1             # of the hypothesis test
MISS = 0.05

BLOCK = "list int, part int, n int, square double, fourth double, ids binary, columns array<binary>, original binary"


@dataclass(frozen=True)
class Lists:
    """The fit: a rotation and at most MOST_LISTS centres; and per list, once all rows are
    filed, their number and the mean and variance of their squared distance to the centre."""
    rotation: np.ndarray
    centers: np.ndarray
    share: np.ndarray
    rows: np.ndarray | None = None
    mean: np.ndarray | None = None
    variance: np.ndarray | None = None

    def parts(self, total: int) -> np.ndarray:
        """Join keys of each list, by its share of the fitted rows."""
        return np.maximum(1, np.ceil(self.share * total / ROWS_A_PART)).astype(np.int64)


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix (the same one for the same number of dimensions)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def fit(rows: DataFrame, total: int, dims: int) -> Lists:
    turn = rotation(dims)
    some = fit_sample(rows, total, "id", "v", FIT_ROWS)
    if not len(some):  # a sample by hash of very few rows may be empty
        some = np.zeros((1, dims))
    turned = some @ turn
    count = int(np.clip(round(np.sqrt(total)), 1, MOST_LISTS))
    centers = lloyd(turned, count)
    at = np.bincount(nearest(turned, centers), minlength=len(centers))
    return Lists(turn, centers, at / at.sum())


def below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function (by the rational approximation of erf with an error
    below 2e-7; it only weighs lists against each other)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (
        -1.453152027 + t * 1.061405429))))
    tail = poly * np.exp(-x * x) / 2
    return np.where(z < 0, tail, 1 - tail)


def expected(lists: Lists, q: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many rows of each list should lie within the squared limit of each query."""
    apart = ((q * q).sum(1)[:, None] + (lists.centers ** 2).sum(1)
             - 2 * q @ lists.centers.T).clip(0)
    mean = apart + lists.mean
    spread = np.sqrt(lists.variance + 4 * apart * lists.mean / q.shape[1]) + 1e-12
    with np.errstate(invalid="ignore"):
        z = np.where(np.isfinite(limit)[:, None], (limit[:, None] - mean) / spread, np.inf)
    return lists.rows * below(z)


def scan(q: np.ndarray, limit: np.ndarray, columns: list[np.ndarray], k: int
         ) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of a block that survive the test at every column block.

    ``limit`` holds squared distances (infinite: none known yet). The first rows of the
    block are compared in full and may lower it.
    """
    dims = q.shape[1]
    edges = np.cumsum([0] + [c.shape[1] for c in columns])
    rows = len(columns[0])
    head = np.concatenate([c[:4 * k] for c in columns], axis=1)
    if len(head) >= k:
        d = ((q * q).sum(1)[:, None] + (head * head).sum(1) - 2 * q @ head.T)
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    # Rounding is of the order of the vectors' squares.
    limit = limit * (1 + 1e-9) + 1e-9 * (q * q).sum(1)
    partial = np.zeros((len(q), rows))
    pairs = None
    for c, (a, b) in zip(columns, zip(edges[:-1], edges[1:])):
        part = q[:, a:b]
        factor = b / dims * (1 + E0 / np.sqrt(b)) ** 2 if b < dims else 1.0
        if pairs is None:
            partial += (part * part).sum(1)[:, None] + (c * c).sum(1) - 2 * part @ c.T
            alive = partial <= limit[:, None] * factor
            if b < dims and alive.mean() > 0.2:
                continue  # still many: the next column block as one product again
            pairs = np.nonzero(alive)
            sums = partial[pairs]
        else:
            sums = sums + ((part[pairs[0]] - c[pairs[1]]) ** 2).sum(1)
            stay = sums <= limit[pairs[0]] * factor
            pairs, sums = (pairs[0][stay], pairs[1][stay]), sums[stay]
    return pairs


def _file(rows: DataFrame, shared, total: int) -> DataFrame:
    """(list, part, id, v): the list of each row, and one of the list's join keys."""
    kind = rows.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        parts = lists.parts(total)
        for batch in batches:
            at = nearest(matrix(batch.column(1)) @ lists.rotation, lists.centers)
            draw = K.mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(draw.astype(np.int64) % parts[at], pa.int32()),
                 *batch.columns], ["list", "part", "id", "v"])

    return rows.select("id", "v").mapInArrow(
        K.tidy(run), f"list int, part int, id long, v {kind}")


def _block(lists: Lists, key: tuple[int, int], ids: np.ndarray, v: np.ndarray) -> dict:
    turned = v @ lists.rotation
    square = ((turned - lists.centers[key[0]]) ** 2).sum(1)
    return {"list": key[0], "part": key[1], "n": len(ids), "square": float(square.sum()),
            "fourth": float((square * square).sum()), "ids": ids.tobytes(),
            "columns": [np.ascontiguousarray(turned[:, a:a + COLUMNS]).tobytes()
                        for a in range(0, turned.shape[1], COLUMNS)],
            "original": v.tobytes()}


def _pack(filed: DataFrame, shared) -> DataFrame:
    """The index: blocks of at most BLOCK_ROWS rows of one list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        key, ids, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [_block(lists, key, np.concatenate(ids), np.concatenate(vectors))], layout)

        layout = pa.schema([
            ("list", pa.int32()), ("part", pa.int32()), ("n", pa.int32()),
            ("square", pa.float64()), ("fourth", pa.float64()), ("ids", pa.binary()),
            ("columns", pa.list_(pa.binary())), ("original", pa.binary())])
        for batch in batches:
            l, p = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i, v = batch.column(2).to_numpy(), matrix(batch.column(3))
            start = np.flatnonzero(np.append(True, (l[1:] != l[:-1]) | (p[1:] != p[:-1])))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(l)]):
                if key != (l[a], p[a]) and ids:
                    yield flush()
                    ids, vectors = [], []
                key = (int(l[a]), int(p[a]))
                while a < b:
                    room = BLOCK_ROWS - sum(map(len, ids))
                    ids.append(i[a:min(b, a + room)])
                    vectors.append(v[a:min(b, a + room)])
                    a += room
                    if a <= b and sum(map(len, ids)) == BLOCK_ROWS:
                        yield flush()
                        ids, vectors = [], []
        if ids:
            yield flush()

    return (filed.repartition("list", "part").sortWithinPartitions("list", "part", "id")
            .mapInArrow(K.tidy(run), BLOCK))


PROBE = "__list int, __part int, first binary, second binary, limits binary, turned binary, vectors binary"


def _probes(queries: DataFrame, shared, total: int, k: int, again: bool) -> DataFrame:
    """Packs of queries, one for each list (and join key of it) that they scan.

    The first time (``again`` False) a query takes the nearest lists until they hold enough
    rows; then, with its limit known, the lists that should hold rows within it, without
    those of the first time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        parts = lists.parts(total)
        for batch in batches:
            for a in range(0, len(batch), PACK):
                some = batch.slice(a, PACK)
                v = matrix(some.column(3))
                turned = v @ lists.rotation
                limit = some.column(2).to_numpy(zero_copy_only=False)
                apart = ((lists.centers ** 2).sum(1) - 2 * turned @ lists.centers.T)
                order = np.argsort(apart, axis=1, kind="stable")
                held = np.cumsum(lists.rows[order], axis=1)
                near = np.zeros(apart.shape, bool)
                np.put_along_axis(near, order, (held - lists.rows[order]) < FIRST_ROWS * k, axis=1)
                if again:
                    hope = expected(lists, turned, limit)
                    order = np.argsort(-hope, axis=1, kind="stable")
                    ranked = np.take_along_axis(hope, order, axis=1)
                    before = np.cumsum(ranked, axis=1) - ranked
                    wanted = np.zeros(apart.shape, bool)
                    np.put_along_axis(wanted, order, before < (1 - MISS) * ranked.sum(
                        axis=1, keepdims=True), axis=1)
                    near = wanted & ~near
                near &= lists.rows > 0
                first, second = (some.column(c).to_numpy() for c in (0, 1))
                rows = []
                for at in np.flatnonzero(near.any(axis=0)).tolist():
                    own = np.flatnonzero(near[:, at])
                    same = (first[own].tobytes(), second[own].tobytes(), limit[own].tobytes(),
                            turned[own].tobytes(), v[own].tobytes())
                    rows += [(at, p, *same) for p in range(int(parts[at]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], pa.int32() if c < 2 else pa.binary())
                     for c in range(7)],
                    ["__list", "__part", "first", "second", "limits", "turned", "vectors"])

    return queries.select("first", "second", "limit", "v").mapInArrow(K.tidy(run), PROBE)


def _search(probes: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(first, second, id, score): each block's nearest rows to the queries that scan it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(len(batch)):
                row = batch.slice(one, 1).to_pylist()[0]
                first = np.frombuffer(row["first"], np.int64)
                second = np.frombuffer(row["second"], np.int64)
                m, n = len(first), row["n"]
                q = np.frombuffer(row["turned"]).reshape(m, -1)
                columns = [np.frombuffer(c).reshape(n, -1) for c in row["columns"]]
                a, r = scan(q, np.frombuffer(row["limits"]), columns, min(k, n))
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(m, -1)
                y = np.frombuffer(row["original"]).reshape(n, -1)
                score = np.empty(len(a))
                for c in range(0, len(a), 1 << 14):
                    d = x[a[c:c + (1 << 14)]] - y[r[c:c + (1 << 14)]]
                    score[c:c + (1 << 14)] = np.sqrt((d * d).sum(axis=1))
                order = np.lexsort((ids[r], score, a))
                own = a[order]
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
                rank = np.arange(len(own)) - np.repeat(
                    start, np.diff(np.append(start, len(own))))
                top = order[rank < k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[a[top]]), pa.array(second[a[top]]), pa.array(ids[r[top]]),
                     pa.array(score[top])], ["first", "second", "id", "score"])

    # The merge hint: Spark's estimate of the probes' size follows the queries alone.
    both = probes.hint("merge").join(blocks, (F.col("list") == F.col("__list")) & (F.col("part") == F.col("__part")))
    return both.select("first", "second", "limits", "turned", "vectors", "n", "ids", "columns",
                       "original").mapInArrow(
        K.tidy(run), "first long, second long, id long, score double")


def search(rows: DataFrame, query: Column, id_col: str = "vec_id",
           vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` nearest other rows of each query row.

    Scores are Euclidean distances of the original vectors in double precision; nearest
    first, ties by the smaller id. Which rows are found is approximate, see above; a query
    gets ``k`` rows wherever the table has them.

    Equal vectors are filed ``k + 1`` times at most, with their least ids: no query can need
    more of them. Equal queries are searched once. Vectors are told apart by 128-bit digests.

    Rows without an id or a vector, with an empty or a zero vector, with null or non-finite
    components, or of another than the table's most frequent length take no part. Rows that
    share an id count as one, the one with the least vector. An empty table gives no rows;
    other columns are not read. Ids are long.
    """
    spark = rows.sparkSession
    slim, dims, total = usable(rows.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"),
        F.col(vector_col).alias("v"))
        .where(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0)), "v")
    if not total:
        return spark.createDataFrame(
            [], f"query_id long, rank int, `{id_col}` long, score double")
    named = one_per_id(slim, "id", ["v"]).select(
        "*", F.xxhash64("v").alias("first"), F.xxhash64(F.lit("second"), "v").alias("second"))
    copies = Window.partitionBy("first", "second").orderBy("id")
    filed = (named.withColumn("copy", F.row_number().over(copies))
             .where(F.col("copy") <= k + 1).select("id", "v"))
    asked = keep(named.where("query").select("id", "first", "second", "v"), "queries")
    distinct = asked.groupBy("first", "second").agg(F.min_by("v", "id").alias("v"))

    lists = fit(slim, total, dims)
    shared = spark.sparkContext.broadcast(lists)
    blocks = keep(_pack(_file(filed, shared, total), shared), "lists")
    count = len(lists.centers)
    held, mean, variance = np.zeros(count), np.zeros(count), np.zeros(count)
    for r in blocks.groupBy("list").agg(F.sum("n").alias("n"), F.sum("square").alias("s"),
                                        F.sum("fourth").alias("f")).collect():
        held[r["list"]], mean[r["list"]] = r["n"], r["s"] / r["n"]
        variance[r["list"]] = max(0.0, r["f"] / r["n"] - (r["s"] / r["n"]) ** 2)
    shared = spark.sparkContext.broadcast(
        Lists(lists.rotation, lists.centers, lists.share, held, mean, variance))

    # One more than asked for: a query's own row is among the candidates.
    best = Window.partitionBy("first", "second").orderBy("score", "id")

    def nearest_of(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)

    start = distinct.withColumn("limit", F.lit(float("inf")))
    near = keep(nearest_of(_search(_probes(start, shared, total, k, False), blocks, k + 1)),
                "nearest-lists")
    limits = near.groupBy(F.col("first").alias("f"), F.col("second").alias("s")).agg(
        F.when(F.count("*") == k + 1, F.max("score")).otherwise(float("inf")).alias("d"))
    known = (distinct.join(limits, (F.col("first") == F.col("f")) & (F.col("second") == F.col("s")),
                           "left")
             .select("first", "second", "v",
                     F.coalesce(F.col("d") * F.col("d"), F.lit(float("inf"))).alias("limit")))
    more = _search(_probes(known, shared, total, k, True), blocks, k + 1)
    found = keep(nearest_of(near.drop("place").unionByName(more)), "nearest-rows")
    answers = (asked.select(F.col("id").alias("query_id"), F.col("first").alias("f"),
                            F.col("second").alias("s"))
               .join(found, (F.col("first") == F.col("f")) & (F.col("second") == F.col("s")))
               .where(F.col("id") != F.col("query_id")))
    # Of k + 1 places one at most was the query's own.
    own = (asked.select(F.col("id").alias("query_id"), F.col("first").alias("f"),
                        F.col("second").alias("s"))
           .join(found.select("first", "second", F.col("id").alias("o"), F.col("place").alias("at")),
                 (F.col("first") == F.col("f")) & (F.col("second") == F.col("s"))
                 & (F.col("o") == F.col("query_id"))).select(F.col("query_id").alias("q"), "at"))
    rank = F.col("place") - F.when(F.col("at") < F.col("place"), 1).otherwise(0)
    return (answers.join(own, F.col("query_id") == F.col("q"), "left")
            .select("query_id", rank.cast("int").alias("rank"), F.col("id").alias(id_col), "score")
            .where(F.col("rank") <= k))
