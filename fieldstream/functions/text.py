"""Text payload rules of the receiving side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import py_float

# --- fixed values -----------------------------------------------------------
CHATTER_PREFIXES = ("RXDONE", "RSSI", "OK", "NULL", "SNR")
ACK_LINES = ("OK", "NULL")
ERROR_WORDS = ("ERROR", "UNKNOWN")
ERROR_LINE = "ERR"
RESET_NOTICE = "TAKE EFFECT AFTER ATZ"
SEND_FAILURE_WORDS = ("NO ACK", "TIMEOUT", "FAILED", "FAIL")
HEX_TOKEN = r"(?<![\p{L}\p{N}_])[0-9A-Fa-f]{2}(?![\p{L}\p{N}_])"
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000")
KEY_VALUE = r"(?U)(\w+)=([-+]?[\d.]+)"
MIN_PAYLOAD_BYTES = 3
CSV_VALUES = 5
# --- end of fixed values ----------------------------------------------------


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def lenient_utf8(raw: Column) -> Column:
    """Decode bytes as UTF-8, leaving out what is not valid."""
    return F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�", "")


def is_chatter(line: Column) -> Column:
    return F.upper(strip(line)).rlike("^(" + "|".join(CHATTER_PREFIXES) + ")")


def is_ack(line: Column) -> Column:
    return F.upper(strip(line)).isin(*ACK_LINES)


def is_error_line(line: Column) -> Column:
    upper = F.upper(line)
    found = upper == ERROR_LINE
    for word in ERROR_WORDS:
        found = found | upper.contains(word)
    return found


def asks_reset(line: Column) -> Column:
    return F.upper(line).contains(RESET_NOTICE)


def reports_send_failure(line: Column) -> Column:
    upper = F.upper(line)
    found = F.lit(False)
    for word in SEND_FAILURE_WORDS:
        found = found | upper.contains(word)
    return found


def hex_tokens(line: Column) -> Column:
    """Two-digit hex words before the first comma; NULL for a part that begins with ``-``,
    which is the tail of a split line."""
    head = strip(F.split_part(line, F.lit(","), F.lit(1)))
    return F.when(~head.startswith("-"), F.regexp_extract_all(head, F.lit(HEX_TOKEN), F.lit(0)))


def hex_payload(tokens: Column) -> Column:
    """Payload digits of the hex words; NULL for a fragment of fewer than three bytes."""
    return F.when(F.size(tokens) >= MIN_PAYLOAD_BYTES, F.array_join(tokens, ""))


def clean_ascii(raw: Column) -> Column:
    """Text of a payload without NUL and replacement characters; NULL unless valid UTF-8."""
    text = F.try_validate_utf8(raw.cast("string"))
    return strip(F.translate(text, "\u0000�", ""))


def _last_per_key(entries: Column) -> Column:
    """Entries without those whose key comes again later."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(keys, i + 2, F.size(keys)), lambda k: k == e["key"]))


def _json_entries(text: Column) -> Column:
    """Entries of a JSON object with lower-cased keys: number, else text; others left out."""
    members = F.map_entries(
        F.when(text.startswith("{"), F.try_parse_json(text)).try_cast("map<string,variant>"))

    def shape(member):
        kind = F.schema_of_variant(member["value"])
        spelled = F.try_variant_get(member["value"], "$", "string")
        number = F.when(kind == "STRING", py_float(spelled)).when(
            ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & (kind != "VOID"),
            F.try_variant_get(member["value"], "$", "double"))
        return F.struct(
            F.lower(member["key"]).alias("key"),
            number.alias("num"),
            F.when((kind == "STRING") & number.isNull(), spelled).alias("str"))

    return F.filter(F.transform(members, shape),
                    lambda e: e["num"].isNotNull() | e["str"].isNotNull())


def _kv_entries(text: Column) -> Column:
    keys = F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(
        F.lower(k).alias("key"), py_float(v).alias("value")))
    return F.filter(pairs, lambda p: p["value"].isNotNull())


def _csv_numbers(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda p: F.length(p) > 0)
    return F.transform(parts, py_float)


def text_candidates(text: Column) -> dict[str, Column]:
    """The readings of a payload text from which ``text_fields`` picks one. Kept as columns
    of their own, so that each is worked out once."""
    return {
        "_json": _last_per_key(_json_entries(text)),
        "_kv": _last_per_key(_kv_entries(text)),
        "_scalar": py_float(text),
        "_csv": _csv_numbers(text),
    }


def text_fields(csv_values: int | None = CSV_VALUES) -> Column:
    """Struct(kind, num, str) chosen from the columns of ``text_candidates``.

    Tried in turn: JSON object, ``key=value`` pairs, one number, a list of numbers (the
    first ``csv_values`` are kept, None: all), and otherwise bare text.
    """
    json, kv, scalar, csv = (F.col(c) for c in ("_json", "_kv", "_scalar", "_csv"))
    csv_ok = (F.size(csv) >= 2) & F.forall(csv, lambda v: v.isNotNull())
    csv_entries = F.transform(
        csv if csv_values is None else F.slice(csv, 1, csv_values),
        lambda v, i: F.struct(F.concat(F.lit("value_"), i.cast("string")), v))
    no_num = F.expr("cast(map() as map<string,double>)")
    no_str = F.expr("cast(map() as map<string,string>)")

    def branch(kind, num, texts=no_str):
        return F.struct(F.lit(kind).alias("kind"), num.alias("num"), texts.alias("str"))

    def pick(name):
        return F.map_from_entries(F.transform(
            F.filter(json, lambda e: e[name].isNotNull()),
            lambda e: F.struct(e["key"], e[name])))

    return (
        F.when(json.isNotNull(), branch("json", pick("num"), pick("str")))
        .when(F.size(kv) > 0, branch("kv", F.map_from_entries(kv)))
        .when(scalar.isNotNull(), branch("scalar", F.create_map(F.lit("value"), scalar)))
        .when(csv_ok, branch("csv", F.map_from_entries(csv_entries)))
        .otherwise(branch("text", no_num))
    )


def iso_utc(seconds: Column) -> Column:
    """ISO-8601 text with ``+00:00`` of whole unix seconds, whatever the session time zone."""
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))
    second = F.pmod(seconds, F.lit(86400))

    def two(number):
        return F.lpad(number.cast("int").cast("string"), 2, "0")

    return F.concat(
        day.cast("string"), F.lit("T"), two(F.floor(second / 3600)), F.lit(":"),
        two(F.floor(F.pmod(second, F.lit(3600)) / 60)), F.lit(":"),
        two(F.pmod(second, F.lit(60))), F.lit("+00:00"))
