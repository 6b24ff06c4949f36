"""The packet codec on Arrow batches.

Every packet needs its CRC, so its bytes go through an Arrow function in any case; the
header and the payload are read in the same pass, column by column over the whole batch.
As native expressions the four layouts would need some forty chains of text slicing and
base conversion per row, too much code for one generated method.

A payload holds only the fields whose mask bit is set, so a field starts at the sum of
the sizes of the earlier fields present.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from ..plans.layouts import (
    CRC_BYTES,
    DERIVED,
    EVENT_TYPES,
    HEADER_BYTES,
    LAYOUTS,
    PROTOCOL_VERSION,
    TYPE_IDS,
    all_decoded_columns,
)
from .binary import ccitt_step, checksum, flat_bytes

REJECT_REASONS = (
    None, "too short", "crc mismatch", "unsupported version", "unsupported msg_type",
    "payload too short", "trailing bytes", "unsupported event_type",
)
SHORT, BAD_CRC, BAD_VERSION, BAD_TYPE, SHORT_PAYLOAD, TRAILING, BAD_EVENT = range(1, 8)

_COMPUTED = {name for entries in DERIVED.values() for name, _, _ in entries}
_WIRE = [c for c in all_decoded_columns() if c not in _COMPUTED]
# Header members: name, byte offset, size, SQL type.
_HEADER = (
    ("version", 0, 1, "int"), ("msg_type", 1, 1, "int"), ("event_type", 2, 1, "int"),
    ("device_id", 3, 1, "int"), ("seq", 4, 2, "int"), ("packet_ts", 6, 4, "bigint"),
    ("field_mask", 10, 2, "int"),
)
_SQL = {"int": IntegerType(), "bigint": LongType()}
_DECODED = StructType(
    [StructField("reject", IntegerType())]
    + [StructField(name, _SQL[kind]) for name, _, _, kind in _HEADER]
    + [StructField(name, DoubleType()) for name in _WIRE])
_ENCODED = StructType([
    StructField("packet", BinaryType()), StructField("field_mask", IntegerType()),
    StructField("clamped", LongType())])


def _unsigned(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(len(at), dtype=np.int64)
    for i in range(size):
        value = (value << 8) | flat[at + i]
    return value


def _decode(packets: pa.Array) -> pa.StructArray:
    flat, start, length = flat_bytes(packets)
    rows = np.flatnonzero(length >= HEADER_BYTES + CRC_BYTES)
    start, length = start[rows], length[rows]
    body = length - CRC_BYTES
    head = {name: _unsigned(flat, start + at, size) for name, at, size, _ in _HEADER}
    mask, kind = head["field_mask"], head["msg_type"]

    expected = np.full(len(rows), -1, dtype=np.int64)
    for name, fields in LAYOUTS.items():
        here = kind == TYPE_IDS[name]
        expected[here] = sum(((mask[here] >> f.ord) & 1) * f.size for f in fields)
    have = body - HEADER_BYTES
    reject = np.select(
        [checksum(flat, start, body, ccitt_step) != _unsigned(flat, start + body, CRC_BYTES),
         head["version"] != PROTOCOL_VERSION, expected < 0, have < expected, have > expected,
         ~np.isin(head["event_type"], list(EVENT_TYPES))],
        [BAD_CRC, BAD_VERSION, BAD_TYPE, SHORT_PAYLOAD, TRAILING, BAD_EVENT], 0)

    numbers = {name: np.full(len(packets), np.nan) for name in _WIRE}
    for name, fields in LAYOUTS.items():
        here = np.flatnonzero((reject == 0) & (kind == TYPE_IDS[name]))
        at = start[here] + HEADER_BYTES
        for field in fields:
            present = ((mask[here] >> field.ord) & 1).astype(bool)
            value = _unsigned(flat, at[present], field.size)
            if field.signed:
                value = value - ((value > field.high) << (8 * field.size))
            number = value / field.divisor if field.divisor != 1 else value
            numbers[field.name][rows[here[present]]] = number
            at = at + present * field.size

    good = np.zeros(len(packets), dtype=bool)
    good[rows] = reject == 0
    reasons = np.full(len(packets), SHORT, dtype=np.int32)
    reasons[rows] = reject
    arrays = [pa.array(reasons)]
    for name, _, _, sql in _HEADER:
        column = np.zeros(len(packets), dtype=np.int64 if sql == "bigint" else np.int32)
        column[rows] = head[name]
        arrays.append(pa.array(column, mask=~good))
    arrays += [pa.array(column, mask=np.isnan(column)) for column in numbers.values()]
    return pa.StructArray.from_arrays(arrays, names=_DECODED.names)


@F.arrow_udf(_DECODED)
def _decoder(packets: pa.Array) -> pa.Array:
    return _decode(packets)


# Runs once per row wherever it is written (see ``binary``).
decoder = _decoder.asNondeterministic()


def _ints(values: pa.Array) -> np.ndarray:
    return np.asarray(values.fill_null(0)).astype(np.int64)


def _put(out: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, size: int):
    for i in range(size):
        out[rows, at + i] = (value >> (8 * (size - 1 - i))) & 0xFF


def _encode(names, kind, event, device, seq, time, columns) -> pa.StructArray:
    n = len(kind)
    codes = _ints(kind)
    widest = max(sum(f.size for f in fields) for fields in LAYOUTS.values())
    out = np.zeros((n, HEADER_BYTES + widest + CRC_BYTES), dtype=np.uint8)
    end = np.full(n, HEADER_BYTES, dtype=np.int64)
    mask, clamped = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    values = dict(zip(names, columns, strict=True))
    for name, fields in LAYOUTS.items():
        here = np.flatnonzero(codes == TYPE_IDS[name])
        if not len(here):
            continue
        for field in fields:
            if field.name not in values:
                continue
            column = values[field.name]
            present = ~np.asarray(column.is_null())[here]
            rows = here[present]
            number = np.asarray(column.fill_null(0.0))[rows] * field.scale
            whole = np.rint(number)
            inside = np.clip(whole, field.low, field.high)
            _put(out, rows, end[rows], inside.astype(np.int64), field.size)
            mask[rows] |= field.bit
            clamped[rows] |= np.where(inside != whole, field.bit, 0)
            end[rows] += field.size
    everything = np.arange(n)
    parts = {"version": np.full(n, PROTOCOL_VERSION), "msg_type": codes,
             "event_type": _ints(event), "device_id": _ints(device), "seq": _ints(seq),
             "packet_ts": _ints(time), "field_mask": mask}
    for name, at, size, _ in _HEADER:
        _put(out, everything, np.full(n, at), parts[name], size)
    width = out.shape[1]
    flat = out.reshape(-1)
    crc = checksum(flat, everything * width, end, ccitt_step).astype(np.int64)
    _put(out, everything, end, crc, CRC_BYTES)
    length = end + CRC_BYTES
    used = np.arange(width) < length[:, None]
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    packed = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out[used])])
    missing = np.asarray(kind.is_null())
    packets = pa.compute.if_else(pa.array(missing), pa.scalar(None, pa.binary()), packed)
    return pa.StructArray.from_arrays(
        [packets, pa.array(mask.astype(np.int32)), pa.array(clamped)], names=_ENCODED.names)


def encoder(names: Sequence[str]):
    """Arrow function of (type code, event code, device, seq, time, *values by name).

    Returns packet, field mask and the mask of clamped fields; no packet where the type
    code is NULL.
    """
    names = tuple(names)

    @F.arrow_udf(_ENCODED)
    def encode(kind: pa.Array, event: pa.Array, device: pa.Array, seq: pa.Array,
               time: pa.Array, *columns: pa.Array) -> pa.Array:
        return _encode(names, kind, event, device, seq, time, columns)

    return encode.asNondeterministic()
