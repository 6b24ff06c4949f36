"""File sinks: fixed-column CSV, routed Parquet, point text, and fan-out to several."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import iso_utc
from ..operators.points import event_points, line_protocol, route
from ..plans import dimensions as dim
from ..plans.layouts import all_decoded_columns, event_csv_columns
from ..session import materialise

Sink = Callable[[DataFrame, int], None]


def _iso_us(column: str) -> Column:
    return iso_utc(F.floor(F.col(column) / F.lit(1_000_000)))


def _blankable(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(name).cast("string")
    if name.startswith("cell_") and name.endswith("_mv") and "cells_mv" in df.columns:
        return F.get("cells_mv", F.lit(int(name.split("_")[1]) - 1)).cast("string")
    if name.startswith("reg_") and "unidentified" in df.columns:
        return F.try_element_at("unidentified", F.lit(int(name[4:]))).cast("string")
    return F.lit(None).cast("string")


def device_rows(readings: DataFrame, device_type: str, time: str = "t_us",
                keep: Sequence[str] = ()) -> DataFrame:
    """The declared columns of one device type: blanks where absent, extras left out."""
    names = dim.DEVICE_CSV_COLUMNS[device_type]
    return readings.where(F.col("device_type") == device_type).select(
        *keep, _iso_us(time).alias("timestamp"),
        F.col("device_id").cast("string").alias("device_id"),
        *[_blankable(readings, n).alias(n) for n in names])


def event_rows(events: DataFrame, time: str = "received_us",
               keep: Sequence[str] = ()) -> DataFrame:
    """All message types under one header; only events that carry a packet time."""
    meta = {
        "received_at": _iso_us(time),
        "packet_timestamp": iso_utc(F.col("packet_ts")),
    }
    cols = [meta[c].alias(c) if c in meta else
            (F.col(c).cast("string").alias(c) if c in events.columns
             else F.lit(None).cast("string").alias(c))
            for c in event_csv_columns()]
    return events.where(F.col("packet_ts").isNotNull()).select(*keep, *cols)


def union_types(*tables: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Tables of different message types under the one stable header."""
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table, allowMissingColumns=True)
    columns = ("msg_type", "event_type", "device_id", "seq", "packet_ts")
    have = set(first.columns)
    return first.select(*keep, *[
        F.col(c) if c in have else F.lit(None).cast("double").alias(c)
        for c in (*columns, *all_decoded_columns())])


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Read back with the declared columns, all as text; no schema inference."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)


def layout_path(base: str, columns: Sequence[str]) -> str:
    """Sub-folder for one column layout."""
    digest = hashlib.sha256("\x1f".join(columns).encode()).hexdigest()[:16]
    return f"{base}/schema={digest}"


def write_rotating(rows: DataFrame, base: str) -> str:
    """Append under the folder of the rows' own layout.

    When the columns change, rows go to a fresh folder and the earlier files stay as they
    are, so no file ever mixes two headers.
    """
    path = layout_path(base, rows.columns)
    write_csv(rows, path)
    return path


def write_routed(events: DataFrame, path: str, buckets: dict[str, str] | None = None,
                 default: str = dim.DEFAULT_BUCKET) -> None:
    """Parquet partitioned by bucket. Rows are written where they are, without a shuffle,
    so a bucket that holds most rows is still written by all tasks."""
    route(events, buckets, default).write.mode("append").partitionBy("bucket").parquet(path)


def write_points(events: DataFrame, path: str, time: str = "received_us",
                 tags: dict[str, str] | None = None) -> None:
    """Time-series points as text files, one point per line."""
    line_protocol(event_points(events, time, tags)).write.mode("append").text(path)


def fan_out(events: DataFrame, sinks: dict[str, Sink], batch_id: int = 0) -> DataFrame:
    """Hand the events to every sink; one that fails does not stop the others.

    Returns one row per sink: name, whether it worked, and the error's type. The rows are
    written to the shared folder first, so the input is computed once and a lost executor
    costs nothing.
    """
    held = materialise(events, "fan-out")
    outcomes = []
    for name, sink in sinks.items():
        try:
            sink(held, batch_id)
            outcomes.append((name, True, None))
        except Exception as error:  # noqa: BLE001 - a failing sink is an outcome
            outcomes.append((name, False, type(error).__name__))
    return events.sparkSession.createDataFrame(
        outcomes, "sink string, ok boolean, error string")
