"""Frames that carry several packets: magic byte, count, then length-prefixed packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary as b
from ..plans.layouts import BATCH_MAGIC, BATCH_MAX_BYTES, BATCH_MAX_PACKETS


def build_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  packet: str = "packet", bare_single: bool = False) -> DataFrame:
    """One frame per group of packets, or the reason why there is none.

    Sizes are summed first, pre-aggregated before the shuffle, and only groups that fit a
    frame are collected: at most 180 bytes each, however many packets a group has.
    """
    size = F.length(packet)
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_packets"),
        (F.sum(size + 1) + 2).alias("frame_bytes"),
        F.sum(((size < 1) | (size > 255) | size.isNull()).cast("int")).alias("_bad"))
    error = (
        F.when(F.col("n_packets") > BATCH_MAX_PACKETS, "too many packets")
        .when(F.col("_bad") > 0, "element size out of range")
        .when(F.col("frame_bytes") > BATCH_MAX_BYTES, "frame too long"))
    totals = totals.withColumn("build_error", error).drop("_bad")
    fitting = totals.where(F.col("build_error").isNull()).select(*keys)
    element = F.concat(b.to_hex(F.length(packet), 1), b.hex_text(F.col(packet)))
    frames = (
        df.join(fitting, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(*order, element.alias("hex")))).alias("_parts"))
    )
    bodies = F.array_join(F.transform("_parts", lambda p: p["hex"]), "")
    frame = F.concat(b.to_hex(F.lit(BATCH_MAGIC), 1), b.to_hex(F.size("_parts"), 1), bodies)
    if bare_single:
        frame = F.when(F.size("_parts") == 1, F.substring(bodies, 3, 2 * BATCH_MAX_BYTES)) \
            .otherwise(frame)
    return (
        totals.join(frames, list(keys), "left")
        .select(*keys, "n_packets", "frame_bytes", "build_error", F.unhex(frame).alias("frame"))
    )


def is_batch(data: Column) -> Column:
    return (F.length(data) >= 2) & (F.hex(F.substring(data, 1, 1)) == F.lit(f"{BATCH_MAGIC:02X}"))


def _cut(hexed: Column) -> Column:
    """Walk the declared elements: struct(at, reason, parts).

    A frame has at most 255 elements, so the walk is bounded; it stops growing at the
    first problem.
    """
    total = (F.length(hexed) / 2).cast("int")
    count = b.unsigned_at(hexed, 1, 1).cast("int")
    start = F.struct(
        F.lit(2).alias("at"), F.lit(None).cast("string").alias("reason"),
        F.expr("cast(array() as array<string>)").alias("parts"))

    def step(acc, _):
        length = b.unsigned_at(hexed, acc["at"], 1).cast("int")
        missing = acc["at"] >= total
        short = acc["at"] + 1 + length > total
        failed = F.when(missing, "truncated: missing length byte").when(
            short, "truncated: element shorter than declared")
        piece = F.substring(hexed, acc["at"] * 2 + 3, length * 2)
        good = acc["reason"].isNull() & ~missing & ~short
        return F.struct(
            F.when(good, acc["at"] + 1 + length).otherwise(acc["at"]).alias("at"),
            F.coalesce(acc["reason"], failed).alias("reason"),
            F.when(good, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"])
            .alias("parts"))

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(
        F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, step, lambda acc: F.struct(
        F.coalesce(acc["reason"], F.when(acc["at"] != total, "trailing bytes")).alias("reason"),
        acc["parts"].alias("parts")))


def split_batches(df: DataFrame, frame: str = "frame",
                  single_as_element: bool = False) -> DataFrame:
    """One row per packet of each frame, with ``element_pos`` from 0.

    A frame that is truncated or has bytes left over is rejected whole: one row with its
    ``reject_reason`` and no packet. What is no batch frame is rejected too, or with
    ``single_as_element`` taken as one bare packet. A NULL frame gives no row.
    """
    whole = F.struct(
        F.lit(None if single_as_element else "not a batch frame").cast("string").alias("reason"),
        F.array(F.col("_hex") if single_as_element else F.lit(None).cast("string"))
        .alias("parts"))
    cut = df.withColumn("_hex", b.hex_text(F.col(frame))).withColumn(
        "_cut", F.when(is_batch(F.col(frame)), _cut(F.col("_hex"))).otherwise(whole))
    failed = F.col("_cut.reason")
    parts = F.when(failed.isNull(), F.col("_cut.parts")).otherwise(
        F.array(F.lit(None).cast("string")))
    parts = F.when(F.col(frame).isNotNull(), parts)
    # The outer form keeps the optimizer from adding a filter on the array's size, for
    # which every frame would be cut twice.
    return (
        cut.select(*df.columns, failed.alias("reject_reason"),
                   F.posexplode_outer(parts).alias("element_pos", "_part"))
        .where(F.col("element_pos").isNotNull())
        .withColumn("packet", F.unhex("_part"))
        .drop("_part")
    )
