"""Counters of links and pollers per interval, and runs of failures.

Intervals are fixed tumbling windows of five seconds; the device-side counters close an
interval at the first event five seconds after the last report instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.policies import POLL_GIVE_UP, REPORT_SECONDS
from .timeline import Timeline


def window_start(time_us: str, seconds: int):
    return (F.floor(F.col(time_us) / F.lit(seconds * 1_000_000)) * seconds).alias("window_s")


def send_stats(df: DataFrame, keys: Sequence[str], time: str = "t_us",
               seconds: int = REPORT_SECONDS) -> DataFrame:
    """Sends accepted and failed per stream and interval."""
    return df.groupBy(*keys, window_start(time, seconds)).agg(
        F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def poll_health(df: DataFrame, keys: Sequence[str], time: str = "t_us",
                tie: str = "poll_id", seconds: int = REPORT_SECONDS) -> DataFrame:
    """Polls that worked, failed or came with a sensor fault, and the last error."""
    failed = ~F.col("ok")
    return df.groupBy(*keys, window_start(time, seconds)).agg(
        F.count_if(F.col("ok")).alias("n_ok"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(F.col("ok") & F.col("has_fault")).alias("n_fault"),
        F.max(F.when(failed, F.struct(time, tie, "error")))["error"].alias("last_error"))


def error_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               give_up: int = POLL_GIVE_UP, limit: int | None = None) -> DataFrame:
    """Every failed poll with its place in the run of failures and the wait that follows."""
    line = Timeline(df, keys, order, limit).scan(
        _failures=("sum", F.when(F.col("ok"), 0).otherwise(1).cast("long")))
    line = line.scan(_at_success=("last", F.when(F.col("ok"), F.col("_failures"))))
    failed = line.rows.where(~F.col("ok"))
    nth = F.col("_failures") - F.coalesce(F.col("_at_success"), F.lit(0))
    return (
        failed.withColumn("consecutive", nth)
        .withColumn("backoff_s", F.least(2.0 * F.col("consecutive"), F.lit(10.0)))
        .withColumn("gives_up", F.col("consecutive") >= give_up)
        .drop("_failures", "_at_success")
    )
