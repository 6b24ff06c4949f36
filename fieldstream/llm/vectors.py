"""What the three vector operators share: usable rows, matrices from Arrow, a bounded fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for an array that is there, has entries, and all of them are finite numbers."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(
            ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))),
        F.lit(False))


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """The rows with a finite vector of the table's usual length, that length, their number.

    The usual length is the most frequent one (of equally frequent ones the largest). Lengths
    are counted over the whole table; there are as many groups as lengths.
    """
    good = rows.where(finite(vector))
    sizes = (good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    if not sizes:
        return good.where(F.lit(False)), 0, 0
    return good.where(F.size(vector) == sizes[0]["d"]), sizes[0]["d"], sizes[0]["n"]


def one_per_id(rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Rows with an id, of those that share one the first by ``order``.

    Only ids are counted; whole rows are compared just for the ids that occur repeatedly.
    """
    named = rows.where(F.col(id_col).isNotNull())
    again = (named.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__n"))
             .where("__n > 1").select("__id"))
    if not again.limit(1).count():
        return named
    same = F.col(id_col) == F.col("__id")
    first = F.min_by(F.struct(*named.columns), F.struct(*order)).alias("r")
    return named.join(again, same, "left_anti").unionByName(
        named.join(again, same, "left_semi").groupBy(F.col(id_col).alias("__id"))
        .agg(first).select("r.*"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_sample(rows: DataFrame, total: int, key: str, vector: str, most: int) -> np.ndarray:
    """About ``most`` of the rows' vectors, by a hash of their key (all, if there are fewer).

    This is the only set of vectors that comes to the driver; it does not grow with the table.
    """
    draw = F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1_000_000_007)) / 1_000_000_007.0
    some = rows.where(draw < F.lit(float(most) / max(total, 1))).select(key, vector)
    table = some.toArrow().sort_by(key)
    return matrix(table.column(1).combine_chunks()) if len(table) else np.zeros((0, 0))


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The index of the nearest centre of each point, in slices of bounded size."""
    half = (centers * centers).sum(1) / 2
    step = max(1, (1 << 22) // max(1, len(centers)))
    out = [np.argmin(half - points[i:i + step] @ centers.T, axis=1)
           for i in range(0, len(points), step)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def lloyd(points: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of the points, begun at random ones, so dense places get more."""
    rng = np.random.default_rng(seed)
    centers = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        at = nearest(points, centers)
        count = np.bincount(at, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, at, points)
        held = count > 0
        centers[held] = total[held] / count[held, None]
    return centers[count > 0] if len(points) else centers
