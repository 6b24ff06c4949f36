"""Whitening of embeddings from an exact, bit-sliced scatter matrix.

Vectors become whole numbers. Over blocks of distinct vectors each dimension is shifted to
start at 0 and cut into bit planes, packed across rows into 64-bit words. The cross product
of two dimensions is then the sum over their planes of ``2^(a+b)`` times the ones of the two
planes' AND: exact, whatever the order of rows or partitions. Blocks undo their shift in
whole numbers, Spark adds up the totals, and ``n * cross - sum * sum`` centres them before
the first division. The eigenvectors come from that matrix, which has as many rows as a
vector has dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep
from fieldstream.llm.vectors import matrix, usable

SCALE, ORIGIN = 64, 1_000_000
BLOCK_ROWS = 4096
COMPONENTS = 16

LAYOUT = ("component int, n long, deviation decimal(38,0), whitened double, "
          "explained double, identity_error double")


def lattice(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c) of every entry; the fixed origin is left out, which changes no
    centred value."""
    y = np.floor(scale * vectors)
    if y.size and np.abs(y).max() >= 2.0 ** 62:
        raise OverflowError("an entry is too large for whole numbers of 64 bits")
    return y.astype(np.int64)


def _key(y: np.ndarray) -> list[bytes]:
    """One byte string per row, equal for equal rows: 16-bit entries where all fit."""
    small = (np.abs(y) < 1 << 15).all(axis=1)
    narrow = y.astype("<i2")
    return [narrow[i].tobytes() if s else y[i].astype("<i8").tobytes()
            for i, s in enumerate(small.tolist())]


def _rows(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(keys), dims), np.int64)
    short = np.array([len(k) == 2 * dims for k in keys])
    for picked, kind in ((short, "<i2"), (~short, "<i8")):
        at = np.flatnonzero(picked)
        if len(at):
            out[at] = np.frombuffer(b"".join(keys[i] for i in at.tolist()), kind).reshape(-1, dims)
    return out


def block_scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross products (upper triangle filled) of a block, as Python integers."""
    n, dims = y.shape
    low = y.min(axis=0)
    shifted = (y - low).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    padded = np.zeros((dims, -(-n // 64) * 64), np.uint64)
    padded[:, :n] = shifted.T
    planes = np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8),
                                   axis=1).view(np.uint64) for b in range(bits)], axis=1)
    # 2^(a+b) * count stays below 2^63 for moderate ranges; else Python's integers take over.
    kind = np.int64 if 2 * bits + n.bit_length() + 1 < 63 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    cross = np.zeros((dims, dims), dtype=object)
    for i in range(dims):
        line = np.zeros(dims - i, dtype=kind)
        for a in range(bits):
            ones = np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64)
            line = line + (ones.astype(kind) * weight).sum(axis=1) * weight[a]
        cross[i, i:] = line
    base = low.astype(object)
    part = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(object) @ np.array(
        [1 << b for b in range(bits)], dtype=object)
    # sum (s_i + l_i)(s_j + l_j) from the shifted values s and the block's least ones l.
    cross = cross + np.outer(base, part) + np.outer(part, base) + n * np.outer(base, base)
    return part + n * base, cross


def _scatter(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, cross products) over the whole fit list; one row per pair of dimensions
    comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a in range(0, len(keys), BLOCK_ROWS):
                y = _rows(keys[a:a + BLOCK_ROWS], dims)
                s, c = block_scatter(y)
                n, sums, cross = n + len(y), sums + s, cross + c
        if n:
            i, j = np.triu_indices(dims)
            index_i = np.concatenate([[-1], np.full(dims, -1), i])
            index_j = np.concatenate([[-1], np.arange(dims), j])
            values = [n, *sums.tolist(), *cross[i, j].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(index_i, pa.int32()), pa.array(index_j, pa.int32()),
                 pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["i", "j", "s"])

    found = (fit.mapInArrow(K.tidy(run), "i int, j int, s decimal(38,0)")
             .groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect())
    total = {(r["i"], r["j"]): int(r["s"]) for r in found}
    n = total.get((-1, -1), 0)
    sums = np.array([total.get((-1, j), 0) for j in range(dims)], dtype=object)
    cross = np.zeros((dims, dims), dtype=object)
    for (i, j), v in total.items():
        if i >= 0:
            cross[i, j] = cross[j, i] = v
    return n, sums, cross


def covariance(n: int, sums: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """(n * cross - sum * sum) / n^2: whole numbers up to one correctly rounded division."""
    centred = n * cross - np.outer(sums, sums)
    return np.array([[int(v) / (n * n) for v in line] for line in centred], dtype=np.float64)


def _centred(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - sums, exact: 64-bit where it fits, else Python's integers."""
    most = n * max(1, int(np.abs(y).max())) + max(1, max(abs(int(s)) for s in sums))
    if most < 1 << 62:
        return n * y - sums.astype(np.int64)
    return n * y.astype(object) - sums


def _squares(z: np.ndarray) -> list[Decimal]:
    top = int(np.abs(z).max())
    if z.dtype == np.int64 and z.shape[1] * top * top < 1 << 63:
        return [Decimal(v) for v in (z * z).sum(axis=1).tolist()]
    wide = z.astype(object)
    return [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: the whitened value and what it was made from.

    ``n`` distinct whole-number vectors make the fit list. ``deviation`` is the exact sum of
    ``(n * x - S)^2``, a decimal because it outgrows 64 bits at about 20 million vectors;
    ``identity_error`` is measured on the whitened fit list. Components whose eigenvalue is
    0 to double precision cannot be whitened and are left out (so equal vectors alone give
    no rows). Rows with a null or empty vector, with null or non-finite entries, or of
    another than the table's most frequent length take no part. Repeated rows and null ids
    are returned as they come; an empty table gives none; other columns are not read.
    """
    spark = rows.sparkSession
    id_type = rows.schema[id_col].dataType.simpleString()
    slim, dims, total = usable(
        rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v")
    empty = spark.createDataFrame([], f"`{id_col}` {id_type}, {LAYOUT}")
    if not total:
        return empty

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = lattice(matrix(batch.column(0)), scale)
            yield pa.RecordBatch.from_arrays([pa.array(_key(y), pa.binary())], ["y"])

    fit = keep(slim.select("v").mapInArrow(K.tidy(keys), "y binary").distinct(), "fit-list")
    n, sums, cross = _scatter(fit, dims)
    spread = covariance(n, sums, cross)
    value, vector = np.linalg.eigh(spread)
    order = np.argsort(-value, kind="stable")[:components]
    floor = max(float(value.max()), 0.0) * dims * np.finfo(np.float64).eps
    order = order[value[order] > floor]
    if not len(order):
        return empty
    root = np.sqrt(value[order])
    axes = vector[:, order]
    share = value[order] / np.trace(spread)
    count = len(order)

    def values(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = _centred(y, n, sums)
        return z, (z.astype(np.float64) / n) @ axes / root

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            held = batch.column(0).to_pylist()
            for a in range(0, len(held), BLOCK_ROWS):
                w = values(_rows(held[a:a + BLOCK_ROWS], dims))[1]
                total, first = total + w.T @ w, first + w.sum(axis=0)
        i, j = np.indices((count, count)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.full(count, -1)]), pa.int32()),
             pa.array(np.concatenate([j, np.arange(count)]), pa.int32()),
             pa.array(np.concatenate([total.ravel(), first]))], ["i", "j", "s"])

    measured = {(r["i"], r["j"]): r["s"] for r in
                fit.mapInArrow(K.tidy(products), "i int, j int, s double")
                .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    mean = np.array([measured[-1, j] for j in range(count)]) / n
    seen = np.array([[measured[i, j] for j in range(count)] for i in range(count)]) / n
    error = float(np.abs(seen - np.outer(mean, mean) - np.eye(count)).max())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(a, BLOCK_ROWS)
                z, w = values(lattice(matrix(batch.column(1)), scale))
                rows_in = len(batch)
                again = pa.array(np.repeat(np.arange(rows_in), count))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(again),
                     pa.array(np.tile(np.arange(1, count + 1), rows_in), pa.int32()),
                     pa.array(np.full(rows_in * count, n), pa.int64()),
                     pa.array(_squares(z), pa.decimal128(38, 0)).take(again),
                     pa.array(w.ravel()), pa.array(np.tile(share, rows_in)),
                     pa.array(np.full(rows_in * count, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained",
                     "identity_error"])

    return (slim.select("id", "v").mapInArrow(K.tidy(finish), f"id {id_type}, {LAYOUT}")
            .withColumnRenamed("id", id_col))
