"""Binary packets: readings to bytes and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import REJECT_REASONS, decoder, encoder
from ..functions.numeric import c_to_f, py_round
from ..plans.layouts import (
    DERIVED,
    EVENT_IDS,
    EVENT_TYPES,
    LAYOUTS,
    MSG_TYPES,
    TYPE_IDS,
    all_decoded_columns,
)

DERIVED_BUILDERS = {
    "c_to_f_rounded": lambda celsius: py_round(c_to_f(celsius), 2),
}


def _name_sql(code: str, names: dict[int, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in names.items()) + " END"


def _by_name(name: Column, numbers: dict[str, int]) -> Column:
    found = F.lit(None).cast("int")
    for text, number in numbers.items():
        found = F.when(name == text, number).otherwise(found)
    return found


def encode_packets(df: DataFrame, msg_type: str | None = None) -> DataFrame:
    """Add ``packet``, ``field_mask``, ``clamped`` and ``encode_error`` to readings.

    Readings need ``device_type``, ``device_id``, ``event_type``, ``seq`` and
    ``packet_ts`` (unix seconds), and any columns of the layouts; text columns and NULLs
    stay off the wire, and values out of range are clamped and named in ``clamped``.
    With ``msg_type`` all rows must be of that type; without it each row is laid out by
    its ``device_type``, so a mixed table is encoded in one pass.
    """
    kinds = dict(df.dtypes)
    types = [msg_type] if msg_type else list(LAYOUTS)
    known = F.col("device_type").isin(*[t.lower() for t in types])
    error = F.when(~F.coalesce(known, F.lit(False)), "wrong device_type")
    if "MPPT" in types:
        no_index = F.col("mppt_index").isNull() if "mppt_index" in kinds else F.lit(True)
        error = error.when((F.col("device_type") == "mppt") & no_index, "missing mppt_index")
    names = dict.fromkeys(f.name for t in types for f in LAYOUTS[t])
    values = [F.col(n).cast("double") if kinds.get(n, "string") != "string"
              else F.lit(None).cast("double") for n in names]
    code = _by_name(F.upper("device_type"), TYPE_IDS)
    wire = encoder(list(names))
    clamp_names = F.array().cast("array<string>")
    for t in types:
        clamp_names = F.when(
            F.col("device_type") == t.lower(), F.array(*[F.lit(f.name) for f in LAYOUTS[t]])
        ).otherwise(clamp_names)
    return (
        df.withColumn("encode_error", error)
        .withColumn("_wire", wire(
            F.when(F.col("encode_error").isNull(), code),
            _by_name(F.col("event_type"), EVENT_IDS), F.col("device_id").cast("long"),
            F.col("seq").cast("long"), F.col("packet_ts").cast("long"), *values))
        .withColumns({
            "packet": F.col("_wire.packet"),
            "field_mask": F.when(F.col("encode_error").isNull(), F.col("_wire.field_mask")),
            "clamped": F.filter(clamp_names, lambda _, i: F.getbit("_wire.clamped", i) == 1),
        })
        .drop("_wire")
    )


def decode_packets(df: DataFrame, packet: str = "packet") -> DataFrame:
    """Decode a packet column into header, field and ``reject_reason`` columns.

    One reason per bad packet, checked in this order: too short, CRC, version, message
    type, payload length (short, then trailing), event type. Mask bits without a field are
    ignored. Values come as doubles so that all types share one column set. Conditions on
    other columns belong before this call: nothing is pushed through it.
    """
    header = ("version", "msg_type", "event_type", "device_id", "seq", "packet_ts", "field_mask")
    wire = [c for c in all_decoded_columns() if c not in _derived_names()]
    kept = [c for c in df.columns if c not in header and c not in all_decoded_columns()]
    reasons = ", ".join("null" if r is None else f"'{r}'" for r in REJECT_REASONS)
    decoded = df.select(*kept, decoder(F.col(packet)).alias("_d")).selectExpr(
        *[f"`{c}`" for c in kept],
        f"element_at(array({reasons}), _d.reject + 1) as reject_reason",
        "_d.version as version",
        _name_sql("_d.msg_type", MSG_TYPES) + " as msg_type",
        _name_sql("_d.event_type", EVENT_TYPES) + " as event_type",
        *[f"_d.{c} as {c}" for c in ("device_id", "seq", "packet_ts", "field_mask", *wire)])
    return add_derived(decoded).select(*kept, "reject_reason", *header, *all_decoded_columns())


def _derived_names() -> set[str]:
    return {name for entries in DERIVED.values() for name, _, _ in entries}


def add_derived(decoded: DataFrame, registry=None, builders=None) -> DataFrame:
    """Add the computed columns of each type; both registries may be replaced."""
    builders = {**DERIVED_BUILDERS, **(builders or {})}
    for msg_type, entries in (registry or DERIVED).items():
        for name, source, builder in entries:
            decoded = decoded.withColumn(name, F.when(
                F.col("msg_type") == msg_type, builders[builder](F.col(source))))
    return decoded


def decoded_only(decoded: DataFrame) -> DataFrame:
    """Events of a known message type that decoded without a reject reason."""
    return decoded.where(F.col("reject_reason").isNull() & F.col("msg_type").isin(*TYPE_IDS))


def rejects(decoded: DataFrame, stage: str, raw: str, *keep: str) -> DataFrame:
    """Side table of what could not be used: stage, reason and the raw bytes."""
    return decoded.where(F.col("reject_reason").isNotNull()).select(
        *keep, F.lit(stage).alias("stage"), F.col("reject_reason").alias("reason"),
        F.col(raw).alias("raw"))
