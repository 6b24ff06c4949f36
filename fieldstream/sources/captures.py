"""Scans of recorded captures: modem lines, bus frames, sensor conversions, modem replies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.timeline import Timeline
from ..plans import dimensions as dim

RX_LOG_SCHEMA = "session_id bigint, line_no bigint, rx_us bigint, raw string"
STANDARD_MASK, EXTENDED_MASK, STANDARD_TOP = 0x7FF, 0x1FFFFFFF, 0x7FF


def read_rx_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Tab-separated modem log: session, line number, receive time, raw text.

    The order is a column of the log, because a distributed text scan has none of its own.
    """
    reader = spark.readStream if streaming else spark.read
    return (
        reader.format("csv").schema(RX_LOG_SCHEMA)
        .option("sep", "\t").option("quote", "").option("escape", "").load(path)
    )


def complete_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Newline-terminated lines of raw bytes; an unterminated tail is held back.

    Bytes that are not valid UTF-8 are left out, lines are stripped and empty ones dropped.
    """
    text = t.lenient_utf8(F.col(raw))
    pieces = F.split(text, "\n")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    return (
        df.select(*[c for c in df.columns if c != raw],
                  F.posexplode_outer(whole).alias("line_pos", "_line"))
        .withColumn("line", t.strip(F.col("_line"))).drop("_line")
        .where(F.length("line") > 0)
    )


def reassembled_lines(chunks: DataFrame, keys: Sequence[str], order: Sequence[str],
                      raw: str = "raw", limit: int | None = None) -> DataFrame:
    """(keys, line_no, line): complete lines of captures that were recorded in byte chunks.

    A chunk may end anywhere, also within a character. Lines are numbered per capture from
    0 by the line feeds before them; a piece at a chunk's edge meets the rest of its line by
    that number, so only edges are shuffled and a line may span any number of chunks. An
    unterminated tail is held back. Bytes that are not valid UTF-8 are left out, lines are
    stripped, and empty ones dropped (their numbers stay unused).
    """
    # One character per byte, so that a cut character survives splitting.
    pieces = F.split(F.decode(F.coalesce(raw, F.lit(b"")), "ISO-8859-1"), "\n")
    cut = chunks.select(*keys, *order, pieces.alias("_pieces")).withColumn(
        "_ends", F.size("_pieces") - 1)
    numbered = Timeline(cut, keys, order, limit).scan(
        _before=("before", F.col("_ends").cast("long"))).rows
    single = numbered.select(*keys, *order, "_before", "_ends",
                             F.posexplode("_pieces").alias("_pos", "_piece"))
    single = single.withColumn("line_no", F.col("_before") + F.col("_pos"))
    inner = (F.col("_pos") > 0) & (F.col("_pos") < F.col("_ends"))
    edges = single.where(~inner).groupBy(*keys, "line_no").agg(
        F.max(F.col("_pos") < F.col("_ends")).alias("_ended"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "_piece"))),
                                 lambda x: x["_piece"]), "").alias("_piece"))
    whole = single.where(inner).select(*keys, "line_no", "_piece").unionByName(
        edges.where("_ended").drop("_ended"))
    text = t.lenient_utf8(F.encode("_piece", "ISO-8859-1"))
    return whole.select(*keys, "line_no", t.strip(text).alias("line")).where(
        F.length("line") > 0)


def modem_replies(df: DataFrame, line: str = "line") -> DataFrame:
    """Flag each modem reply line: error, asks for a reset, reports a failed send."""
    return df.withColumns({
        "is_error": t.is_error_line(F.col(line)),
        "needs_reset": t.asks_reset(F.col(line)),
        "send_failed": t.reports_send_failure(F.col(line)),
    })


def reply_outcome(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome per send over all its reply lines (pre-aggregated before the shuffle)."""
    return modem_replies(replies).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.bool_or(c).alias(c) for c in ("is_error", "needs_reset", "send_failed")])


def id_filter(ids: Sequence[int], column: str = "can_id", extended: str = "extended") -> Column:
    """Exact match on ids under the 11-bit or 29-bit mask of each id."""
    short = [i for i in ids if i <= STANDARD_TOP]
    long = [i for i in ids if i > STANDARD_TOP]
    masked = {m: F.col(column).bitwiseAND(F.lit(m)) for m in (STANDARD_MASK, EXTENDED_MASK)}
    match = ~F.col(extended) & masked[STANDARD_MASK].isin(*short)
    if long:
        match = match | (F.col(extended) & masked[EXTENDED_MASK].isin(*long))
    return match


def bus_frames(df: DataFrame) -> DataFrame:
    """Frames of mapped ids that are neither error nor remote frames, with their kind.

    The ``isin`` repeats the join condition so that it reaches the file scan as a filter.
    """
    ids = dim.bus_id_table(df.sparkSession)
    return (
        df.where(~F.col("is_error") & ~F.col("is_remote"))
        .where(F.col("can_id").isin(*dim.BUS_IDS))
        .join(F.broadcast(ids), "can_id", "inner")
        .drop("is_error", "is_remote")
    )


def unmapped_frames(df: DataFrame) -> DataFrame:
    """Valid frames whose id nobody mapped."""
    ids = dim.bus_id_table(df.sparkSession).select("can_id")
    return (
        df.where(~F.col("is_error") & ~F.col("is_remote"))
        .join(F.broadcast(ids), "can_id", "left_anti")
    )


def sensor_conversions(df: DataFrame) -> DataFrame:
    """15-bit codes of temperature conversions.

    The fault register counts only when the low bit of the code says so. When the
    configuration reads back differently the board was off the bus: a reject.
    """
    faulted = F.col("lsb").bitwiseAND(F.lit(1)) == 1
    return df.withColumns({
        "raw_code": F.shiftright(
            F.shiftleft(F.col("msb"), 8).bitwiseOR(F.col("lsb")), 1),
        "fault_status": F.when(faulted, F.col("fault_status")).otherwise(0),
        "reject_reason": F.when(
            F.col("config_read") != F.col("config_expected"), "config mismatch"),
    }).drop("msb", "lsb", "config_read", "config_expected")
