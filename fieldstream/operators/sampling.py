"""Latest values at ticks, the drive timer, and the held discharge peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policies import DRIVE_THRESHOLD_A
from .timeline import Timeline


def latest_at_ticks(readings: DataFrame, ticks: DataFrame, keys: Sequence[str],
                    values: Sequence[str], time: str = "t_us", tick: str = "tick_us",
                    limit: int | None = None, tie: str | None = None) -> DataFrame:
    """As-of: the newest reading at or before each tick; readings between are passed over.

    Of readings with one time the one with the largest ``tie`` counts.

    Ticks and readings are laid in one time line per key and the last reading is carried
    forward, so there is no join. A tick before the first reading is left out. A silent
    device repeats its last value, which ``staleness_s`` shows.
    """
    reading = readings.select(
        *keys, F.col(time).alias("_at"), F.lit(0).alias("_is_tick"),
        (F.col(tie) if tie else F.lit(None).cast("long")).alias("_tie"),
        F.struct(F.col(time).alias("seen"), *values).alias("_value"))
    asked = ticks.select(
        *keys, F.col(tick).alias("_at"), F.lit(1).alias("_is_tick"),
        F.lit(None).cast(reading.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(reading.schema["_value"].dataType).alias("_value"))
    line = Timeline(reading.unionByName(asked), keys, ["_at", "_is_tick", "_tie"], limit)
    scanned = line.scan(_latest=("last", F.col("_value"))).rows
    return (
        scanned.where((F.col("_is_tick") == 1) & F.col("_latest").isNotNull())
        .select(*keys, F.col("_at").alias(tick), F.col("_latest.seen").alias(time),
                ((F.col("_at") - F.col("_latest.seen")) / F.lit(1_000_000.0))
                .alias("staleness_s"),
                *[F.col(f"_latest.{v}").alias(v) for v in values])
    )


def latest_per_key(readings: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """Newest row of each key (pre-aggregated before the shuffle)."""
    newest = readings.groupBy(*keys).agg(
        F.max(F.struct(*order, *values)).alias("_newest"))
    return newest.select(*keys, *[F.col(f"_newest.{c}").alias(c) for c in [*order, *values]])


def drive_start(currents: DataFrame, session: Sequence[str], time: str = "t_us",
                threshold_a: float = DRIVE_THRESHOLD_A) -> DataFrame:
    """First time any source of the session draws more than the threshold.

    ``currents`` holds all sources' readings with ``current_a`` in amperes; discharge is
    negative and the comparison strict. Sessions that never draw have no row.
    """
    return (
        currents.where(F.col("current_a") < -threshold_a)
        .groupBy(*session).agg(F.min(time).alias("drive_start_us"))
    )


def stamp_elapsed(readings: DataFrame, starts: DataFrame, session: Sequence[str],
                  time: str = "t_us") -> DataFrame:
    """Add ``elapsed_s``: whole seconds since the drive started, 0 before or without one.

    The start table grows with the number of sessions, so no broadcast is forced: AQE
    takes it where the size allows and splits a dominating session otherwise.
    """
    since = F.floor((F.col(time) - F.col("drive_start_us")) / F.lit(1_000_000))
    return (
        readings.join(starts, list(session), "left")
        .withColumn("elapsed_s", F.greatest(F.coalesce(since, F.lit(0)), F.lit(0)).cast("long"))
        .drop("drive_start_us")
    )


def peak_hold(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_us",),
              current: str = "current_ma", sent_ok: str = "tx_ok",
              limit: int | None = None) -> DataFrame:
    """Add ``peak_current_ma``: deepest discharge since the last successful send.

    The peak of a failed send is carried into the next one; NULL when nothing was drawn.
    An epoch ends with its successful send; epochs are themselves time lines, so one that
    never succeeds is still cut into slices when it is long.
    """
    epochs = Timeline(df, keys, order, limit).scan(
        epoch=("before", F.col(sent_ok).cast("long"))).rows
    drawn = F.when(F.col(current) < 0, F.col(current))
    return Timeline(epochs, [*keys, "epoch"], order, limit).scan(
        peak_current_ma=("min", drawn)).rows


def peak_discharge(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_us",),
                   current: str = "current_ma", sent_ok: str = "tx_ok",
                   limit: int | None = None) -> DataFrame:
    """Deepest discharge per send epoch."""
    epochs = Timeline(df, keys, order, limit).scan(
        epoch=("before", F.col(sent_ok).cast("long"))).rows
    return epochs.groupBy(*keys, "epoch").agg(
        F.min(F.when(F.col(current) < 0, F.col(current))).alias("peak_current_ma"))
