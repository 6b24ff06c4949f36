"""Small helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.session import materialise

#: A table is broadcast only when it is known to have at most so many rows.
BROADCAST_ROWS = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def third(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 marks the held-out documents."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % 3


def bounded_sample(rows: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """Of each group about ``most`` rows, taken by a hash of ``key`` (all, if it has fewer).

    The share is set from exact counts per group, so a group gives at most
    ``most + 6 * sqrt(most)`` keys but for a chance below 1e-8. Only keys and groups are
    joined; the wide rows are then filtered by the chosen keys.
    """
    slim = rows.select(F.col(key).alias("__key"), F.col(group).alias("__group"))
    counts = slim.groupBy("__group").agg(F.count("*").alias("__n"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "__key"), F.lit(1_000_000_007)) / 1_000_000_007.0
    chosen = (slim.join(counts, "__group").where(draw < F.lit(float(most)) / F.col("__n"))
              .select("__key").distinct())
    return rows.join(maybe_broadcast(chosen, chosen.count()),
                     F.col(key) == F.col("__key"), "left_semi")


#: Bytes of a batch that goes to a Python worker. Texts make batches of the usual 10,000 rows
#: tens of megabytes, which the JVM, the pipe and the worker each hold.
ARROW_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The rows as they are; from here on the session's Arrow batches hold ARROW_BYTES at most
    (or less, where the session says so in bytes)."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = str(conf.get(name)).removesuffix("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """The broadcast hint where the counted rows allow it; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def keep(df: DataFrame, name: str) -> DataFrame:
    return materialise(df, f"{name}-{uuid.uuid4().hex[:6]}")
