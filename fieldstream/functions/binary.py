"""Bytes, bits and checksums as column expressions.

Everything here is a native expression except the checksums: a CRC walks every byte,
which as a higher-order function is interpreted per byte. The Arrow UDFs below handle
a whole column batch per call instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

# --- fixed values -----------------------------------------------------------
CRC_SEED = 0xFFFF
CCITT_POLYNOMIAL = 0x1021
MODBUS_POLYNOMIAL = 0xA001
# --- end of fixed values ----------------------------------------------------


def _ccitt_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint16) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CCITT_POLYNOMIAL, table << 1)
    return table.astype(np.uint16)


def _modbus_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ MODBUS_POLYNOMIAL, table >> 1)
    return table.astype(np.uint16)


_CCITT, _MODBUS = _ccitt_table(), _modbus_table()


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column laid end to end, with the start and length of each value."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)
    offsets = offsets[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def checksum(flat: np.ndarray, start: np.ndarray, length: np.ndarray, step) -> np.ndarray:
    """CRC of many byte runs at once: one table step per byte position, over all rows that
    are that long."""
    crc = np.full(len(start), CRC_SEED, dtype=np.uint16)
    by_length = np.argsort(-length, kind="stable")
    ordered = -length[by_length]
    for position in range(int(length.max(initial=0))):
        live = by_length[:np.searchsorted(ordered, -position, side="left")]
        crc[live] = step(crc[live], flat[start[live] + position])
    return crc


def ccitt_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (crc << 8) ^ _CCITT[(crc >> 8) ^ byte]


def modbus_step(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (crc >> 8) ^ _MODBUS[(crc ^ byte) & 0xFF]


def _with_nulls(result: np.ndarray, values: pa.Array) -> pa.Array:
    mask = np.asarray(values.is_null()) if values.null_count else None
    return pa.array(result.astype(np.int32), type=pa.int32(), mask=mask)


@F.arrow_udf(IntegerType())
def crc16_ccitt(values: pa.Array) -> pa.Array:
    """CRC-16, polynomial 0x1021, seed 0xFFFF, not reflected."""
    return _with_nulls(checksum(*flat_bytes(values), ccitt_step), values)


@F.arrow_udf(IntegerType())
def crc16_modbus(values: pa.Array) -> pa.Array:
    """CRC-16, reflected polynomial 0xA001, seed 0xFFFF."""
    return _with_nulls(checksum(*flat_bytes(values), modbus_step), values)


@F.arrow_udf(IntegerType())
def byte_sum(values: pa.Array) -> pa.Array:
    """Sum of all bytes of each value."""
    flat, start, length = flat_bytes(values)
    running = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    return _with_nulls(running[start + length] - running[start], values)


_REPLY = StructType([
    StructField("crc", IntegerType()), StructField("sent_crc", IntegerType()),
    StructField("head", ArrayType(IntegerType())), StructField("words", ArrayType(IntegerType()))])


@F.arrow_udf(_REPLY)
def modbus_reply(frames: pa.Array) -> pa.Array:
    """Computed and sent checksum of reply frames, their first three bytes (fewer of a shorter
    frame), and the 16-bit words after these."""
    flat, start, length = flat_bytes(frames)
    body = np.maximum(length - 2, 0)
    crc = checksum(flat, start, body, modbus_step)
    sent = np.full(len(frames), -1, dtype=np.int32)
    closed = np.flatnonzero(length >= 2)
    tail = start[closed] + body[closed]
    sent[closed] = flat[tail] + (flat[tail + 1].astype(np.int32) << 8)
    count = np.maximum(body - 3, 0) // 2
    ends = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(start + 3 - 2 * ends[:-1], count) + 2 * np.arange(ends[-1])
    words = (flat[at].astype(np.int32) << 8) | flat[at + 1]
    first = np.minimum(length, 3)
    upto = np.concatenate(([0], np.cumsum(first)))
    head = flat[np.repeat(start - upto[:-1], first) + np.arange(upto[-1])]
    lists = [pa.ListArray.from_arrays(pa.array(stops, type=pa.int32()),
                                      pa.array(values, type=pa.int32()))
             for stops, values in ((upto, head), (ends, words))]
    return pa.StructArray.from_arrays(
        [pa.array(crc.astype(np.int32)), pa.array(sent), *lists], names=_REPLY.names)


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column laid end to end, and how many each row has (a null: none)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), size.astype(np.int64)


@F.arrow_udf(BinaryType())
def modbus_frame(heads: pa.Array, words: pa.Array) -> pa.Array:
    """Frames of the head's bytes, the words (their low 16 bits, high byte first; a null list
    has none) and the Modbus checksum, low byte first."""
    flat, start, length = flat_bytes(heads)
    values, count = list_parts(words)
    values = values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = length + 2 * count + 2
    ends = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(ends[-1], dtype=np.uint8)

    def places(at: np.ndarray, many: np.ndarray, step: int) -> np.ndarray:
        before = np.cumsum(many) - many
        return np.repeat(at - step * before, many) + step * np.arange(many.sum())

    out[places(ends[:-1], length, 1)] = flat[places(start, length, 1)]
    word = places(ends[:-1] + length, count, 2)
    out[word], out[word + 1] = (values >> 8) & 0xFF, values & 0xFF
    crc = checksum(out, ends[:-1], size - 2, modbus_step)
    out[ends[1:] - 2], out[ends[1:] - 1] = crc & 0xFF, crc >> 8
    frames = pa.Array.from_buffers(pa.binary(), len(heads), [
        None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
    return pc.if_else(heads.is_valid(), frames, None) if heads.null_count else frames


# An expression holding a Python function may be copied by the optimizer, for instance
# when a filter moves below it, and would then run twice per row. Marked like this it
# runs once, where it was written; filter on other columns before it.
crc16_ccitt = crc16_ccitt.asNondeterministic()
crc16_modbus = crc16_modbus.asNondeterministic()
byte_sum = byte_sum.asNondeterministic()
modbus_reply = modbus_reply.asNondeterministic()
modbus_frame = modbus_frame.asNondeterministic()


def hex_text(value: Column) -> Column:
    return F.lower(F.hex(value))


def unsigned_at(hex_column: Column, offset, size: int) -> Column:
    """Big-endian unsigned integer of ``size`` bytes at byte ``offset`` of a hex text."""
    at = (offset if isinstance(offset, Column) else F.lit(offset)) * 2 + 1
    return F.conv(F.substring(hex_column, at.cast("int"), F.lit(2 * size)), 16, 10).cast("long")


def sign_extend(value: Column, bits: int) -> Column:
    return F.when(value >= (1 << (bits - 1)), value - (1 << bits)).otherwise(value)


def signed_at(hex_column: Column, offset, size: int) -> Column:
    return sign_extend(unsigned_at(hex_column, offset, size), 8 * size)


def to_hex(value: Column, size: int) -> Column:
    """Two's-complement big-endian hex of an integer, ``size`` bytes wide."""
    masked = value.cast("long").bitwiseAND(F.lit((1 << (8 * size)) - 1))
    return F.lower(F.lpad(F.hex(masked), 2 * size, "0"))


def with_crc(body: Column) -> Column:
    """Append the big-endian CCITT checksum to a binary value."""
    return F.concat(body, F.unhex(to_hex(crc16_ccitt(body), 2)))


def with_modbus_crc(body: Column) -> Column:
    """Append the Modbus checksum, low byte first."""
    crc = crc16_modbus(body)
    swapped = F.shiftleft(crc.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(crc, 8))
    return F.concat(body, F.unhex(to_hex(swapped, 2)))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0
