"""Sequence numbers and what their gaps say about loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import Timeline

# --- fixed values -----------------------------------------------------------
SEQUENCE_SPAN = 0x10000
PLAUSIBLE_GAP = 0x1000     # larger gaps mean a restart or a repeat, not loss
# --- end of fixed values ----------------------------------------------------


def assign_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    limit: int | None = None) -> DataFrame:
    """Number built packets per stream from 0, wrapping at 65536."""
    scanned = Timeline(df, keys, order, limit).scan(_nth=("count", F.lit(1))).rows
    return scanned.withColumn(
        "seq", ((F.col("_nth") - 1) % SEQUENCE_SPAN).cast("int")).drop("_nth")


def sequence_gaps(df: DataFrame, session: Sequence[str], order: Sequence[str] = ("arrival",),
                  limit: int | None = None) -> DataFrame:
    """Add ``prev_seq``, ``gap`` and ``lost`` to decoded packets.

    The sequence runs per message type, not per device: all boards share one counter.
    ``gap`` wraps at 65536; only gaps from 1 to 4095 count as ``lost``, though any packet,
    early or repeated, becomes the next one's predecessor.
    """
    scanned = Timeline(df, [*session, "msg_type"], order, limit).scan(
        prev_seq=("lag", F.col("seq"))).rows
    gap = F.pmod(F.col("seq") - F.col("prev_seq") - 1, F.lit(SEQUENCE_SPAN))
    return scanned.withColumn("gap", gap.cast("int")).withColumn(
        "lost", F.when((F.col("gap") > 0) & (F.col("gap") < PLAUSIBLE_GAP), F.col("gap"))
        .otherwise(0))


def _percent(lost, total):
    return F.lit(100.0) * lost / total


def running_loss(df: DataFrame, session: Sequence[str], order: Sequence[str] = ("arrival",),
                 limit: int | None = None) -> DataFrame:
    """At every counted gap: packets received and lost in the session so far, all types."""
    gaps = sequence_gaps(df, session, order, limit)
    totals = Timeline(gaps, session, order, limit).scan(
        received=("count", F.lit(1)), total_lost=("sum", F.col("lost").cast("long"))).rows
    return totals.where(F.col("lost") > 0).withColumn(
        "loss_pct", _percent(F.col("total_lost"), F.col("received") + F.col("total_lost")))


def session_loss(df: DataFrame, session: Sequence[str], order: Sequence[str] = ("arrival",),
                 limit: int | None = None) -> DataFrame:
    """Received, lost and loss percentage of each session."""
    totals = sequence_gaps(df, session, order, limit).groupBy(*session).agg(
        F.count(F.lit(1)).alias("received"), F.sum(F.col("lost").cast("long")).alias("lost"))
    return totals.withColumn(
        "loss_pct", _percent(F.col("lost"), F.col("received") + F.col("lost")))
