"""Telemetry inputs derived from the shipped tables, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.functions import binary as b
from fieldstream.operators.loss import assign_sequence
from fieldstream.operators.packets import encode_packets
from fieldstream.plans import dimensions as dim
from fieldstream.session import epoch_us, small_methods, spread

from . import formulas as f

SESSION = ["session_id"]
DEVICE = ["session_id", "device_id"]
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """Events in whole numbers; ``costly`` spreads a scan with few splits over the cores."""
    e = table(spark, sf_dir, "events")
    e = spread(e) if costly else e
    return e.select(
        "event_id", epoch_us(e, "ts").alias("t_us"), "user_id", "event_type", "props",
        (F.col("user_id") % 8).alias("session_id"),
        (F.col("user_id") % 256).cast("int").alias("device_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"))


def readings(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return events(spark, sf_dir, costly).withColumns(
        {name: F.expr(expr) for name, expr in f.READING.items()})


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per event, with wire columns and sequence number; those of the source
    without a layout are turned down by the encoder."""
    e = events(spark, sf_dir).withColumn("device_type", F.expr(f.SOURCE_SQL))
    e = e.withColumn("msg_type", F.upper("device_type"))
    numbered = assign_sequence(e, ["session_id", "msg_type"], ["t_us", "event_id"])
    return numbered.select(
        "event_id", "t_us", "session_id", "device_id", "device_type", "msg_type", "seq", "c",
        F.expr(f.EVENT_TYPE_SQL).alias("event_type"),
        F.expr(f.PACKET_TS).alias("packet_ts"),
        F.expr(f.RECEIVED).alias("received_us"),
        *[F.expr(expr).alias(name) for name, expr in f.typed_columns().items()])


KEYS = ["event_id", "t_us", "received_us", "session_id"]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded packets; readings that cannot be encoded have none."""
    built = encode_packets(typed(spark, sf_dir))
    return built.where("encode_error is null").select(*KEYS, "packet")


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, some of them spoiled in one known way."""
    kind = F.expr(f.CORRUPT)
    hexed = F.hex("packet")
    base = packets(spark, sf_dir).withColumns({
        "_kind": kind, "_body": F.expr("substr(hex(packet), 1, 2 * length(packet) - 4)")})
    body = F.col("_body")

    def put(at, text):
        return F.overlay(body, F.lit(text), F.lit(2 * at + 1), F.lit(2))

    changed = (
        F.when(F.col("_kind") == 2, put(0, "09"))
        .when(F.col("_kind") == 3, put(1, "09"))
        .when(F.col("_kind") == 4, F.expr("substr(_body, 1, length(_body) - 2)"))
        .when(F.col("_kind") == 5, F.concat(body, F.lit("00")))
        .when(F.col("_kind") == 6, put(2, "63")))
    flipped = F.overlay(hexed, b.to_hex(255 - b.unsigned_at(hexed, 5, 1), 1),
                        F.lit(11), F.lit(2))
    spoiled = (
        F.when(F.col("_kind").isNull(), F.col("packet"))
        .when(F.col("_kind") == 0, F.unhex(flipped))
        .when(F.col("_kind") == 1, F.substring("packet", 1, 10))
        .otherwise(F.col("_rebuilt")))
    return (
        base.withColumn("_changed", F.unhex(changed))
        .withColumn("_rebuilt", b.with_crc(F.col("_changed")))
        .withColumn("packet", spoiled).select(*KEYS, "packet")
    )


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded headers with losses: every 17th packet never arrived."""
    e = events(spark, sf_dir).withColumn("device_type", F.expr(f.SOURCE_SQL))
    e = e.withColumn("msg_type", F.upper("device_type"))
    numbered = assign_sequence(e, ["session_id", "msg_type"], ["t_us", "event_id"])
    return numbered.where("event_id % 17 <> 0").select(
        "session_id", "msg_type", "seq", "t_us", F.col("event_id").alias("arrival"))


def spaced(hexed):
    return F.trim(F.regexp_replace(hexed, "(..)", "$1 "))


def rx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw modem output of plain bytes, chatter and fragments."""
    size = F.expr("cast(1 + event_id % 20 as int)")
    body = F.array_join(F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.lpad(F.lower(F.hex((F.col("c") * i) % 256)), 2, "0")), " ")
    line = F.expr("event_id % 10")
    return events(spark, sf_dir, costly=True).select(
        "event_id",
        F.when(line == 0, F.concat(F.lit("rxDone\r\nRssi= -"), F.col("event_id")))
        .when(line == 3, "b502aa55")
        .when(line == 5, F.concat(F.lit("null\r\n  "), body))
        .when(line == 7, "-48,13")
        .otherwise(F.concat(F.lit(" Data: (HEX:) "), body, F.lit(" ,-33,13\r\n\r\nOK\r\n")))
        .alias("raw"))


def rx_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modem lines that carry batches, bare packets, text and junk."""
    base = packets(spark, sf_dir).withColumns({
        "_h": F.lower(F.hex("packet")),
        "_len": b.to_hex(F.length("packet"), 1),
        "c": F.expr("event_id % 1000")})
    h, n = F.col("_h"), F.col("_len")
    bad_tail = F.concat(
        F.expr("substr(_h, 1, length(_h) - 2)"),
        b.to_hex(255 - b.unsigned_at(h, F.length("packet") - 1, 1), 1))
    batch = F.concat(F.lit("b502"), n, h, n, h)
    kind = F.expr("event_id % 10")
    text = F.concat(F.lit("k="), F.col("c"), F.lit(",v=-1.5"))
    payload = (
        F.when(kind == 1, batch)
        .when(kind == 2, F.concat(F.lit("b502"), n, h, n, bad_tail))
        .when(kind == 3, F.expr("substr(_b, 1, length(_b) - 2)"))
        .when(kind == 4, F.lower(F.hex(F.encode(text, "UTF-8"))))
        .when(kind == 5, "fffefd")
        .otherwise(h))
    return base.withColumn("_b", batch).select(
        *KEYS, F.when(kind == 0, "rxDone").otherwise(
            F.concat(F.lit("Data: (HEX:) "), spaced(payload), F.lit(" ,-33,13"))).alias("raw"))


def ascii_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c").cast("string")
    kind = F.expr("event_id % 7")
    text = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, F.concat(
            F.lit('{"Temp": "12.5", "Name": "bob", "Flag": true, "Null": null, '
                  '"Nest": {"a": 1}, "N": '), c, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("k="), c, F.lit(",V=-1.5;z=abc")))
        .when(kind == 3, F.concat(F.lit(" "), c, F.lit(".25 ")))
        .when(kind == 4, F.concat(c, F.lit(", 2, 3,4,5,6,7")))
        .when(kind == 5, F.concat(F.lit("\u0000hello-"), c)))
    return events(spark, sf_dir, costly=True).select(
        "event_id",
        F.when(kind == 6, F.concat(F.unhex(F.lit("fffe")), F.encode(c, "UTF-8")))
        .otherwise(F.encode(text, "UTF-8")).alias("payload"))


def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch frames of short elements, some cut short or with bytes left over."""
    count = F.expr("cast(1 + event_id % 4 as int)")

    def element(i):
        size = (F.lit(3) + (F.col("event_id") + i) % 5).cast("int")
        body = F.array_join(F.transform(
            F.sequence(F.lit(1), size),
            lambda j: F.lpad(F.hex((F.col("c") * j + i) % 256), 2, "0")), "")
        return F.concat(b.to_hex(size, 1), body)

    body = F.concat(F.lit("b5"), b.to_hex(count, 1),
                    F.array_join(F.transform(F.sequence(F.lit(1), count), element), ""))
    spoiled = (
        F.when(F.expr("event_id % 23 = 0"), F.expr("substr(_f, 1, length(_f) - 2)"))
        .when(F.expr("event_id % 23 = 1"), F.concat(F.col("_f"), F.lit("00")))
        .when(F.expr("event_id % 23 = 2"), F.concat(F.lit("b509"), F.expr("substr(_f, 5)")))
        .when(F.expr("event_id % 23 = 3"), F.concat(F.lit("03"), F.expr("substr(_f, 3)")))
        .otherwise(F.col("_f")))
    return events(spark, sf_dir, costly=True).withColumn("_f", body).select(
        "event_id", F.unhex(spoiled).alias("frame"))


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.expr(f"cast({f.FRAME_SIZE} as int)")
    data = F.array_join(F.transform(
        F.sequence(F.lit(1), size),
        lambda j: F.lpad(F.hex((F.col("c") * j) % 256), 2, "0")), "")
    return events(spark, sf_dir).select(
        "event_id", "t_us", "session_id",
        F.expr(f"cast({f.CAN_ID} as int)").alias("can_id"),
        F.lit(False).alias("extended"), size.alias("dlc"), F.unhex(data).alias("data"),
        F.expr("event_id % 43 = 0").alias("is_error"),
        F.expr("event_id % 47 = 0").alias("is_remote"))


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("_w", F.expr(f"({f.RTD_CODE}) * 2 + {f.RTD_FAULT}"))
    return e.select(
        "event_id", "t_us", "session_id", "device_id",
        F.expr("cast(floor(_w / 256) as int)").alias("msb"),
        F.expr("cast(_w % 256 as int)").alias("lsb"),
        F.expr(f"cast({f.RTD_FAULT_STATUS} as int)").alias("fault_status"),
        F.lit(193).alias("config_expected"),
        F.expr("CASE WHEN event_id % 53 = 0 THEN 255 ELSE 193 END").alias("config_read"))


ADDRESSES = [*range(0, 42), *range(113, 129)]


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One poll per order with its register values, in the order of ``ADDRESSES``.

    Spelled out per register, so that each is a small compiled expression.
    """
    orders = small_methods(spread(table(spark, sf_dir, "orders").select("o_orderkey")))
    values = ", ".join(f"cast({f.register(str(r))} as int)" for r in ADDRESSES)
    return orders.select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 8).alias("session_id")
    ).withColumn("pack_cv", F.expr(f.PACK_CV)).selectExpr(
        "k", "session_id", f"array({values}) as regs")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register maps per poll; register 26 is missing from some."""
    addresses = f"array({', '.join(map(str, ADDRESSES))})"
    return polls(spark, sf_dir).withColumn(
        "registers", F.expr(f"map_from_arrays({addresses}, regs)")
    ).select("k", "session_id", F.expr(
        "CASE WHEN k % 23 = 0 THEN map_filter(registers, (r, v) -> r <> 26) "
        "ELSE registers END").alias("registers"))


#: Ranges that some polls ask for again, or anew across others: start, count, what the
#: registers have risen by since, and which polls.
AGAIN = ((0, 32, 1, "k % 5 = 0"), (10, 6, 2, "k % 7 = 0"), (30, 8, 3, "k % 10 = 0"))


def replies(spark: SparkSession, sf_dir: str, again: bool = False) -> DataFrame:
    """Reply frames of every poll; some spoiled, some polls lack their second reply.

    With ``again`` some polls read ranges a second time, in the order of ``reply_no``.
    """
    wanted = [(s, n, 0, "true") for s, n in dim.request_chunks()] + list(AGAIN if again else ())
    ranges = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(n).alias("count"),
                                F.lit(add).alias("add"), F.lit(turn).alias("reply_no"))
                       for turn, (s, n, add, _) in enumerate(wanted)])
    asked = polls(spark, sf_dir).select("k", "session_id", "regs", F.explode(ranges).alias("_r"))
    asked = asked.select("k", "session_id", "regs", "_r.*").where(
        "NOT (k % 23 = 0 AND start = 32)").where(" OR ".join(
            f"(reply_no = {turn} AND {which})" for turn, (_, _, _, which) in enumerate(wanted)))
    asked = asked.withColumns({
        "fault": F.expr(f"CASE WHEN add = 0 THEN {f.REPLY_FAULT} END"),
        "asked": F.expr("slice(regs, if(start < 100, start, start - 71) + 1, count)")})
    # A frame keeps the low 16 bits of a word, as the registers do.
    words = F.when(F.col("add") == 0, F.col("asked")).otherwise(
        F.transform("asked", lambda v: v + F.col("add")))
    head = F.concat(
        F.when(F.col("fault") == 2, "02").otherwise("01"),
        F.when(F.col("fault") == 6, "04").otherwise("03"),
        b.to_hex(F.col("count") * 2 + F.when(F.col("fault") == 4, 2).otherwise(0), 1))
    refused = F.coalesce(F.col("fault") == 3, F.lit(False))
    whole = b.modbus_frame(F.unhex(F.when(refused, "018302").otherwise(head)),
                           F.when(~refused, words))
    last = F.hex(F.expr("substring(_whole, length(_whole), 1)"))
    flipped = F.concat(
        F.expr("substring(_whole, 1, length(_whole) - 1)"),
        F.unhex(b.to_hex(255 - F.conv(last, 16, 10).cast("int"), 1)))
    return (
        asked.withColumn("_whole", whole)
        .select("k", "session_id", F.lit(1).alias("address"), F.lit(3).alias("func"),
                "start", "count", "reply_no",
                F.when(F.col("fault") == 1, flipped)
                .when(F.col("fault") == 5, F.substring("_whole", 1, 3))
                .otherwise(F.col("_whole")).alias("frame"))
    )


def shunt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte lines of the shunt: two blocks per event, some with a wrong checksum."""
    r = readings(spark, sf_dir, costly=True)

    def line(slot, key, value, condition=None):
        text = F.concat(F.lit(f"{key}\t"), value.cast("string"), F.lit("\r\n"))
        item = F.struct(F.lit(slot).alias("slot"), text.alias("text"))
        return item if condition is None else F.when(F.expr(condition), item)

    power = F.col("power_w")
    block_a = [
        line(0, "V", F.col("voltage_mv")), line(1, "I", F.col("current_ma")),
        line(2, "P", power, "event_id % 5 <> 0"),
        line(3, "SOC", F.expr("(c * 3) % 1001")), line(4, "Alarm", F.lit("OFF")),
        line(5, "AR", F.col("alarm")),
        F.when(F.expr("event_id % 37 = 0"), F.struct(
            F.lit(6).alias("slot"), F.lit("noise\r\n").alias("text"))),
    ]
    block_b = [
        line(16, "H1", F.expr("-c")), line(17, "H2", F.expr("c % 777")),
        line(18, "P", power, "event_id % 5 = 0"),
    ]
    blocks = r.select(
        "event_id", "session_id", "t_us",
        F.explode(F.array(
            F.struct(F.lit(7).alias("end"), F.array_compact(F.array(*block_a)).alias("lines")),
            F.struct(F.lit(19).alias("end"), F.array_compact(F.array(*block_b)).alias("lines")),
        )).alias("_b"))
    blocks = blocks.select("event_id", "session_id", "t_us", "_b.end", "_b.lines")
    body = F.encode(F.concat(
        F.array_join(F.transform("lines", lambda x: x["text"]), ""), F.lit("Checksum\t\r\n")),
        "UTF-8")
    blocks = blocks.withColumn("_sum", b.byte_sum(body))
    wrong = F.when(F.expr("event_id % 31 = 0") & (F.col("end") == 7), 1).otherwise(0)
    check = (F.pmod(-F.col("_sum"), F.lit(256)) + wrong) % 256
    closing = F.struct(
        F.col("end").alias("slot"),
        F.concat(F.encode(F.lit("Checksum\t"), "UTF-8"), F.unhex(b.to_hex(check, 1)),
                 F.encode(F.lit("\r\n"), "UTF-8")).alias("raw"))
    lines = F.concat(
        F.transform("lines", lambda x: F.struct(
            x["slot"].alias("slot"), F.encode(x["text"], "UTF-8").alias("raw"))),
        F.array(closing))
    return (
        blocks.select("event_id", "session_id", F.col("t_us").alias("rx_us"),
                      F.explode(lines).alias("_l"))
        .select("session_id", "rx_us",
                (F.col("event_id") * 32 + F.col("_l.slot")).alias("line_no"),
                F.col("_l.raw").alias("raw"))
    )


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("event_id").alias("poll_id"), "t_us", "session_id",
        F.expr("CASE user_id % 2 WHEN 0 THEN 'bms' ELSE 'rtd' END").alias("stream"),
        (F.col("event_type") != "error").alias("ok"),
        F.expr("event_id % 29 = 0").alias("has_fault"),
        F.expr("CASE WHEN event_type = 'error' THEN concat('timeout ', c % 5) END")
        .alias("error"))


def ticks(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Ticks every few hours from each session's first reading to its last."""
    step = hours * HOUR_US
    spans = events(spark, sf_dir).groupBy("session_id").agg(
        F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    first = F.floor(F.col("lo") / F.lit(step)) * step
    return spans.select("session_id", F.explode(
        F.sequence(first, F.col("hi"), F.lit(step))).alias("tick_us"))
