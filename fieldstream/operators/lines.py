"""From modem text lines to events: batch frame, else packet, else text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.binary import hex_text
from .batches import is_batch, split_batches
from .packets import decode_packets

Decoder = Callable[[DataFrame], DataFrame]


def payload_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Non-empty lines of raw modem output, in order (``line_pos`` from 0 per raw row).

    Carriage returns count as line ends; status chatter and bare acknowledgements are
    dropped. ``payload_hex`` is NULL for lines without a usable payload.
    """
    pieces = F.filter(
        F.transform(F.split(F.col(raw), r"[\r\n]"), t.strip), lambda p: F.length(p) > 0)
    # The outer form: for the inner one the optimizer adds a filter on the array's size,
    # which would split every text twice.
    lines = df.select(*[c for c in df.columns if c != raw],
                      F.posexplode_outer(pieces).alias("line_pos", "line"))
    return (
        lines.where(F.col("line_pos").isNotNull()
                    & ~t.is_chatter(F.col("line")) & ~t.is_ack(F.col("line")))
        .withColumn("_tokens", t.hex_tokens(F.col("line")))
        .withColumn("payload_hex", t.hex_payload(F.col("_tokens"))).drop("_tokens")
    )


def ascii_events(df: DataFrame, payload: str = "payload",
                 csv_values: int | None = t.CSV_VALUES) -> DataFrame:
    """Read payload bytes as text: ``text``, ``text_kind``, ``num`` and ``str`` maps.

    ``text`` is NULL where the payload is empty or not valid UTF-8. Of a list of numbers
    the first ``csv_values`` are kept (None: all).
    """
    cleaned = df.withColumn("text", F.nullif(t.clean_ascii(F.col(payload)), F.lit("")))
    return (
        cleaned.withColumns(t.text_candidates(F.col("text")))
        .withColumn("_fields", F.when(F.col("text").isNotNull(), t.text_fields(csv_values)))
        .select(*[c for c in cleaned.columns if c != "payload_hex"],
                hex_text(F.col(payload)).alias("payload_hex"),
                F.col("_fields.kind").alias("text_kind"),
                F.col("_fields.num").alias("num"), F.col("_fields.str").alias("str"))
    )


def decode_lines(df: DataFrame, payload_hex: str = "payload_hex",
                 decoder: Decoder = decode_packets, ascii_fallback: bool = True) -> DataFrame:
    """Events and rejects of payload lines, told apart by ``origin``.

    * ``batch``: an element of a batch frame; a bad container rejects the frame whole and
      is not tried as text, a bad element rejects only itself.
    * ``packet``: a bare packet.
    * ``ascii``: what is no packet but reads as text; only if that fails too does the
      packet's own reject reason stand.

    Container elements and bare packets go through the ``decoder`` together, so the lines
    are read once.
    """
    data = df.withColumn("payload", F.unhex(F.nullif(F.col(payload_hex), F.lit(""))))
    data = data.drop(payload_hex).withColumn("_batch", is_batch(F.col("payload")))
    decoded = decoder(split_batches(data, "payload", single_as_element=True).withColumnRenamed(
        "reject_reason", "_container"))
    decoded = decoded.withColumn(
        "reject_reason", F.coalesce(F.col("_container"), F.col("reject_reason")))
    failed = ~F.col("_batch") & F.col("reject_reason").isNotNull()
    if ascii_fallback:
        decoded = ascii_events(
            decoded.withColumn("_text", F.when(failed, F.col("payload"))), "_text"
        ).drop("_text")
    else:
        decoded = decoded.withColumns({
            "text": F.lit(None).cast("string"), "text_kind": F.lit(None).cast("string"),
            "num": F.lit(None).cast("map<string,double>"),
            "str": F.lit(None).cast("map<string,string>")})
    read_as_text = F.col("text").isNotNull()
    origin = (
        F.when(read_as_text, "ascii")
        .when(F.col("_batch"), "batch")
        .otherwise("packet"))
    return (
        decoded
        .withColumn("origin", origin)
        .withColumn("reject_reason", F.when(read_as_text, None).otherwise(F.col("reject_reason")))
        .withColumn("msg_type", F.when(read_as_text, "ASCII").otherwise(F.col("msg_type")))
        .drop("_batch", "_container", "packet")
    )
