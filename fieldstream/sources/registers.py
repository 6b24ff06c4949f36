"""Battery register polls: reply frames, one snapshot per poll, register profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType

from ..functions import binary as b
from ..functions.binary import list_parts
from ..plans import dimensions as dim


def register_replies(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Check reply frames against what was asked and read their registers.

    Needs ``address``, ``func``, ``start`` and ``count`` of the request. Adds
    ``reject_reason`` and ``registers`` (unsigned 16-bit, NULL when rejected).
    """
    work = df.select("*", b.modbus_reply(F.col(frame)).alias("_r"),
                     F.length(frame).alias("_size"))
    size, wanted = F.col("_size"), F.col("count") * 2
    byte = [F.get(F.col("_r.head"), F.lit(n)) for n in range(3)]
    reason = (
        F.when(size.isNull() | (size < 5), "response too short")
        .when(F.col("_r.crc") != F.col("_r.sent_crc"), "crc mismatch")
        .when(byte[0] != F.col("address"), "wrong address")
        .when(byte[1] == F.col("func").bitwiseOR(F.lit(0x80)), "exception reply")
        .when(byte[1] != F.col("func"), "unexpected function")
        .when((byte[2] != wanted) | (size - 2 != wanted + 3), "byte count"))
    return (
        work.withColumn("reject_reason", reason)
        .withColumn("registers", F.when(F.col("reject_reason").isNull(), F.col("_r.words")))
        .drop("_r", "_size")
    )


def register_snapshot(replies: DataFrame, keys: Sequence[str],
                      order: str = "start") -> DataFrame:
    """One address-to-value map per poll; a poll with any rejected reply is left out.

    Replies are laid over each other in the sequence of ``order``: where ranges overlap, or
    one was asked for again, the later reply wins (of equal ones the larger values). Repeats
    of one range are reduced before the shuffle, so a poll collects one array per distinct
    range at most; the arrays of many polls are laid over each other at once.
    """
    ranges = replies.groupBy(*keys, "start", F.size("registers").alias("_n")).agg(
        F.max(F.struct(F.col(order).alias("at"), F.col("registers").alias("values")))
        .alias("_last"),
        F.max(F.col("reject_reason").isNotNull()).alias("_failed"))
    polls = ranges.groupBy(*keys).agg(
        F.bool_or("_failed").alias("_failed"),
        F.sort_array(F.collect_list(F.struct("_last.at", "start", "_last.values")))
        .alias("_ranges"))
    return polls.where(~F.col("_failed")).select(
        *keys, laid_over(F.col("_ranges.start"), F.col("_ranges.values")).alias("registers"))


@F.arrow_udf(MapType(IntegerType(), IntegerType()))
def laid_over(starts: pa.Array, values: pa.Array) -> pa.Array:
    """One map per row from runs of registers, each from its start on; later runs win."""
    start, runs = list_parts(starts)
    arrays, _ = list_parts(values)
    value, size = list_parts(arrays)
    row = np.repeat(np.repeat(np.arange(len(starts)), runs), size)
    first = np.repeat(start.to_numpy(zero_copy_only=False).astype(np.int64)
                      - (np.cumsum(size) - size), size)
    address = first + np.arange(len(value))
    # Sorted by row and address, equal ones in their order: the last of them stays.
    order = np.argsort((row << 32) + address, kind="stable")
    row, address = row[order], address[order]
    last = np.append((row[1:] != row[:-1]) | (address[1:] != address[:-1]), True)[:len(row)]
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[last], minlength=len(starts)))))
    return pa.MapArray.from_arrays(
        pa.array(ends, pa.int32()), pa.array(address[last], pa.int32()),
        value.take(pa.array(order[last])).cast(pa.int32()))


def _printable(u16: Column) -> Column:
    return (F.shiftright(u16, 8).between(32, 126)
            & u16.bitwiseAND(F.lit(255)).between(32, 126))


def _hex(u16: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(u16), 4, "0"))


def _pair(u16: Column) -> Column:
    return F.concat(F.chr(F.shiftright(u16, 8)), F.chr(u16.bitwiseAND(F.lit(255))))


def _labelled(df: DataFrame) -> DataFrame:
    labels = dim.register_label_table(df.sparkSession)
    return (
        df.join(F.broadcast(labels), F.col("reg") == F.col("label_reg"), "left")
        .withColumn("label", F.coalesce("label", F.lit(""))).drop("label_reg")
    )


def register_dump(snapshots: DataFrame, registers: str = "registers") -> DataFrame:
    """One row per register: hex, unsigned, signed, printable pair and label."""
    rows = snapshots.select(
        *[c for c in snapshots.columns if c != registers],
        F.explode(registers).alias("reg", "u16"))
    u16 = F.col("u16")
    return _labelled(rows.withColumns({
        "hex": _hex(u16),
        "s16": b.sign_extend(u16, 16),
        "ascii_pair": F.when(_printable(u16), _pair(u16)),
    }))


def register_profile(snapshots: DataFrame, registers: str = "registers") -> DataFrame:
    """The dump reduced to one row per register: ranges seen and how often it is text.

    Only whole numbers are aggregated; texts and labels are made from the few results,
    which the order of the numbers allows.
    """
    rows = snapshots.select(F.explode(registers).alias("reg", "u16"))
    u16 = F.col("u16")
    text = F.when(_printable(u16), u16)
    signed = b.sign_extend(u16, 16)
    ranges = rows.groupBy("reg").agg(
        F.count(F.lit(1)).alias("polls"),
        F.min(u16).alias("u16_min"), F.max(u16).alias("u16_max"),
        F.min(signed).alias("s16_min"), F.max(signed).alias("s16_max"),
        F.sum(u16.cast("long")).alias("u16_sum"),
        F.count(text).alias("ascii_polls"), F.max(text).alias("_text"))
    return _labelled(ranges.withColumns({
        "hex_max": _hex(F.col("u16_max")), "ascii_max": _pair(F.col("_text"))}).drop("_text"))
