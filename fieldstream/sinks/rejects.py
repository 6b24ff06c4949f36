"""Events and rejects of a batch in one pass, committed once per batch number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS, REJECTS = "events", "rejects"


def decode_stage(df: DataFrame) -> DataFrame:
    """Name the step that turned a decoded line down: no payload in the line, a batch frame
    (its container or one element), or a bare packet."""
    return df.withColumn("stage", F.when(F.col("reject_reason").isNull(), None)
                         .when(F.col("payload").isNull(), "payload")
                         .when(F.col("origin") == "batch", "batch").otherwise("packet"))


def write_sides(df: DataFrame, base: str, batch_id: int) -> None:
    """Write the rows of a batch below its own number, events and rejects side by side.

    All rows go through one job, so what is rejected is decoded once. A replayed batch
    overwrites the folder of its number and leaves the same rows behind, none twice; no
    other batch is touched.
    """
    side = F.when(F.col("reject_reason").isNull(), EVENTS).otherwise(REJECTS)
    (df.withColumn("side", side).write.mode("overwrite").partitionBy("side")
     .parquet(f"{base}/batch={batch_id}"))


def read_side(spark: SparkSession, base: str, side: str, schema: str) -> DataFrame:
    """One side of all committed batches, with the number of its batch."""
    return (spark.read.schema(f"{schema}, side string, batch bigint").parquet(base)
            .where(F.col("side") == side).drop("side"))
