"""Decoded events as time-series points and as text lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import plain_number
from ..functions.text import iso_utc
from ..plans import dimensions as dim
from ..plans.layouts import EVENT_IDS, LAYOUTS, all_decoded_columns, decoded_columns

NUMERIC = (T.NumericType, T.BooleanType)


def flatten(df: DataFrame, max_items: int | None = None) -> dict[str, Column]:
    """Flat columns ``a_b`` of nested structs; arrays give ``a_0``, ``a_1``, ... up to
    ``max_items``, which the caller has to know; without it a table with an array is
    refused, as no column list could hold all items. Maps keep their own keys and are left
    to map functions.
    """
    flat: dict[str, Column] = {}

    def walk(column: Column, kind: T.DataType, name: str):
        if isinstance(kind, T.StructType):
            for field in kind:
                walk(column[field.name], field.dataType, f"{name}_{field.name}")
        elif isinstance(kind, T.ArrayType):
            if max_items is None:
                raise ValueError(f"{name} is an array: give max_items, or explode it first")
            for i in range(max_items):
                walk(F.get(column, F.lit(i)), kind.elementType, f"{name}_{i}")
        else:
            flat[name] = column

    for field in df.schema:
        walk(F.col(field.name), field.dataType, field.name)
    return flat


def unnested(df: DataFrame, event: str, keep: Sequence[str]) -> DataFrame:
    """(keep, path, num, str): one row per value of a nested column, of any depth and length.

    The path joins field names, array positions from 0 and map keys by ``_``. The schema
    says where to descend, the rows how far. Numbers and booleans come as ``num``, all else
    as ``str``; null values, null or empty arrays and maps give no row.
    """
    def values(column: Column, kind: T.DataType, path: Column) -> Column:
        def below(name: Column) -> Column:
            return F.concat_ws("_", path, name.cast("string"))

        if isinstance(kind, T.StructType):
            parts = [values(column[x.name], x.dataType, below(F.lit(x.name))) for x in kind]
            return F.concat(*parts)
        if isinstance(kind, T.ArrayType):
            found = F.flatten(F.transform(
                column, lambda x, i: values(x, kind.elementType, below(i))))
        elif isinstance(kind, T.MapType):
            found = F.flatten(F.transform(F.map_entries(column), lambda e: values(
                e["value"], kind.valueType, below(e["key"]))))
        else:
            number = isinstance(kind, NUMERIC)
            return F.filter(F.array(F.struct(
                path.alias("path"),
                (column if number else F.lit(None)).cast("double").alias("num"),
                (F.lit(None) if number else column).cast("string").alias("str"))),
                lambda _: column.isNotNull())
        return F.coalesce(found, F.array().cast("array<struct<path:string,num:double,str:string>>"))

    rows = values(F.col(event), df.schema[event].dataType, F.lit(None).cast("string"))
    # A plain explode would make Spark work out the list twice, once to filter by its size.
    return df.select(*keep, F.explode_outer(rows).alias("_value")).where(
        "_value is not null").select(*keep, "_value.*")


def _code(name: Column, numbers: dict[str, int]) -> Column:
    found = F.lit(None).cast("int")
    for text, number in numbers.items():
        found = F.when(name == text, number).otherwise(found)
    return found


def route(df: DataFrame, buckets: dict[str, str] | None = None,
          default: str = dim.DEFAULT_BUCKET) -> DataFrame:
    """Add ``bucket`` by message type, with a default for types without a route.

    The routes are a handful of settings, so they are a literal in the expression rather
    than a join.
    """
    bucket = F.lit(default)
    for msg_type, name in (dim.BUCKETS if buckets is None else buckets).items():
        bucket = F.when(F.col("msg_type") == msg_type, name).otherwise(bucket)
    return df.withColumn("bucket", bucket)


def event_points(events: DataFrame, time: str = "received_us",
                 tags: dict[str, str] | None = None,
                 measurement: str = dim.MEASUREMENT) -> DataFrame:
    """Time-series points: ``tags``, numeric fields ``num``, text fields ``str``.

    Message type and device are tags. Numbers become doubles, the event type its number,
    NULLs are dropped, and the hex text of a payload never becomes a field. Wire fields
    are named ``fields_*``. A point without any number gets ``received = 1``; an event
    that is neither a packet (it has a version) nor a text has nothing usable and gives
    no point. A point's time is when it arrived.

    Text events bring ``num``, ``str`` and ``text``; packets bring their field columns.
    """
    have = set(events.columns)
    header = {
        "version": F.col("version"),
        "event_type": _code(F.col("event_type"), EVENT_IDS),
        "seq": F.col("seq"),
        "timestamp": F.col("packet_ts"),
        "field_mask": F.col("field_mask"),
    }
    numbers = {name: c for name, c in header.items()
               if {"timestamp": "packet_ts"}.get(name, name) in have}
    numbers |= {f"fields_{c}": F.col(c) for c in all_decoded_columns() if c in have}
    pairs = F.array_compact(F.array(*[
        F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.cast("double").alias("value")))
        for n, c in numbers.items()]))
    num = F.map_from_entries(pairs)
    texts = F.expr("cast(map() as map<string,string>)")
    if "num" in have:
        own = F.map_filter("num", lambda k, v: ~k.isin("mppt_index", "device_id"))
        num = F.map_concat(num, F.coalesce(own, F.expr("cast(map() as map<string,double>)")))
    if "str" in have:
        own = F.map_filter("str", lambda k, v: (k != "payload_hex") & (k != "payload"))
        texts = F.map_concat(
            F.coalesce(own, texts),
            F.when(F.col("text").isNotNull(), F.create_map(F.lit("payload"), F.col("text")))
            .otherwise(texts))
    device = F.col("device_id")
    index = F.lit(None).cast("double")
    if "num" in have:
        device = F.coalesce(device, F.try_element_at("num", F.lit("device_id")).cast("int"))
        index = F.try_element_at("num", F.lit("mppt_index"))
    # The event's own tags win over tags of the caller with the same name.
    named = {k: F.lit(v) for k, v in (tags or {}).items()}
    for name, value in (("msg_type", F.col("msg_type")), ("device_id", device.cast("string")),
                        ("mppt_index", F.concat(F.lit("MPPT_"),
                                                index.cast("int").cast("string")))):
        named[name] = F.coalesce(value, named[name]) if name in named else value
    tag_pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value")))
                 if k != "msg_type" else F.struct(F.lit(k).alias("key"), v.alias("value"))
                 for k, v in named.items()]

    usable = [F.col(c).isNotNull() for c in ("version", "text") if c in have]
    shaped = events.where(reduce(lambda a, c: a | c, usable)).withColumns({
        "measurement": F.lit(measurement),
        "tags": F.map_from_entries(F.array_compact(F.array(*tag_pairs))),
        "_num": num,
        "_str": texts,
    })
    received = F.create_map(F.lit("received"), F.lit(1.0))
    kept = [c for c in events.columns
            if c in ("event_id", "arrival", "session_id", "vehicle_id", "msg_type")]
    return shaped.select(
        *kept, "measurement", "tags",
        F.when(F.size("_num") == 0, received).otherwise(F.col("_num")).alias("num"),
        F.col("_str").alias("str"), F.col(time).alias("time_us"))


def _one_line(text: Column) -> Column:
    """Line ends as two characters each: a point is one line of the text sink."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _escaped(text: Column) -> Column:
    return _one_line(F.regexp_replace(text, r"([,= ])", r"\\$1"))


def _joined(pairs: Column, value) -> Column:
    return F.array_join(F.transform(
        F.array_sort(F.map_entries(pairs)),
        lambda e: F.concat(_escaped(e["key"]), F.lit("="), value(e["value"]))), ",")


def _number_text(value: Column) -> Column:
    """Shortest text of a double, without an exponent from 1e-4 up to 1e16, as Python has it."""
    size, text = F.abs(value), value.cast("string")
    whole = (value == F.rint(value)) & (size < 1e15)
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    return (
        F.when(whole, F.concat(value.cast("long").cast("string"), F.lit(".0")))
        .when((size >= 1e-4) & (size < 1e16) & text.contains("E"),
              F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain))
        .otherwise(text))


def line_protocol(points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points as text: measurement, tags, fields, nanoseconds; keys sorted."""
    numbers = _joined(F.col("num"), _number_text)
    texts = _joined(F.col("str"), lambda v: F.concat(
        F.lit('"'), _one_line(F.regexp_replace(v, r'(["\\])', r"\\$1")), F.lit('"')))
    fields = F.concat_ws(",", F.nullif(numbers, F.lit("")), F.nullif(texts, F.lit("")))
    tags = _joined(F.col("tags"), _escaped)
    return points.select(*keep, F.concat(
        _escaped(F.col("measurement")), F.lit(","), tags, F.lit(" "), fields, F.lit(" "),
        (F.col("time_us") * 1000).cast("string")).alias("value"))


def _field_text(name: str, whole: bool) -> Column:
    number = F.col(name).cast("long").cast("string") if whole else plain_number(F.col(name))
    return F.when(F.col(name).isNotNull(), F.concat(F.lit(f"'{name}': "), number))


def _line(msg_type: str, hidden: tuple[str, ...] = ()) -> Column:
    wire = {f.name: f for f in LAYOUTS[msg_type]}
    parts = [_field_text(c, c in wire and wire[c].divisor == 1)
             for c in decoded_columns(msg_type) if c not in hidden]
    return F.concat(
        F.lit(f"[rx:{msg_type.lower()}] event="), F.col("event_type"),
        F.lit(" device="), F.col("device_id").cast("string"),
        F.lit(" seq="), F.col("seq").cast("string"),
        F.lit(" timestamp="), iso_utc(F.col("packet_ts")),
        F.lit(" fields={"), F.concat_ws(", ", *parts), F.lit("}"))


Handler = Callable[[], Column]

# The battery line leaves out the state of charge; it stays in every sink.
HANDLERS: dict[str, Handler] = {
    "BMV": lambda: _line("BMV"),
    "MPPT": lambda: _line("MPPT"),
    "BMS": lambda: _line("BMS", ("soc_pct",)),
    "RTD": lambda: _line("RTD"),
}


def packet_lines(events: DataFrame, handlers: dict[str, Handler] | None = None) -> DataFrame:
    """Add ``line``: one text line per event; NULL for types nobody handles."""
    line = F.lit(None).cast("string")
    for msg_type, handler in (HANDLERS if handlers is None else handlers).items():
        line = F.when(F.col("msg_type") == msg_type, handler()).otherwise(line)
    return events.withColumn("line", line)
