"""Every job: (spark, sf_dir) -> DataFrame, shaped for comparison with the reference SQL.

``SHAPES`` gives each job's columns and types; the same shape wraps the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstream.functions.binary import hex_text
from fieldstream.operators import (
    assembly,
    batches,
    health,
    lines,
    loss,
    normalize,
    packets,
    points,
    sampling,
    send_policy,
)
from fieldstream.operators.timeline import cut_at
from fieldstream.plans import dimensions as dim
from fieldstream.plans.layouts import all_decoded_columns, event_csv_columns
from fieldstream.plans.policies import PolicySpec, ShuntPolicy
from fieldstream.session import materialise, run_dir
from fieldstream.sinks import files, rejects
from fieldstream.sources import captures, registers, shunt_text
from fieldstream.streaming import jobs as streams

from . import formulas as f
from . import inputs as i

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SHAPES: dict[str, str] = {}

S = ["session_id"]
D = ["session_id", "device_id"]

# Policies of the jobs, sized to the spread of the shipped values.
BAND = PolicySpec(
    deltas={"current_ma": 150_000.0, "power_w": 1_200.0, "flag": 1.0}, heartbeat_s=129_600)
SHUNT = ShuntPolicy(voltage_mv=3_500, current_ma=300_000, power_w=2_200, heartbeat_s=86_400)
BEAT_S = 172_800
STATUS_S = 43_200
WARNING_S = 21_600
DRIVE_A = 39.9


def job(name: str, shape: str):
    """Register a job and cast its result to the declared shape."""
    columns = [part.rsplit(" ", 1) for part in shape.split(", ")]

    def register(build: Job) -> Job:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(spark, sf_dir).select(
                *[F.col(c).cast(kind).alias(c) for c, kind in columns])

        JOBS[name], SHAPES[name] = run, shape
        return build

    return register


def many(names, kind: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


def pairs_text(column: str, scale: int = 0, skip: tuple[str, ...] = ()):
    """A map as sorted ``key=value`` text; numbers as scaled whole numbers."""
    entries = F.map_entries(F.map_filter(column, lambda k, v: ~k.isin(*skip)) if skip
                            else F.col(column))
    if scale:
        def value(v):
            return F.rint(v * F.lit(float(scale))).cast("long").cast("string")
    else:
        def value(v):
            return v
    return F.array_join(F.array_sort(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))), ";")


FIELDS = all_decoded_columns()
HEADER_SHAPE = ("version bigint, msg_type string, event_type string, device_id bigint, "
                "seq bigint, packet_ts bigint, field_mask bigint")
DECODED_SHAPE = f"{HEADER_SHAPE}, {many(FIELDS, 'double')}"


# ------------------------------------------------------------------ lines and packets

@job("rx_payloads", "event_id bigint, line_pos bigint, line string, payload_hex string")
def rx_payloads(spark, sf):
    got = lines.payload_lines(i.rx_raw(spark, sf))
    return got.withColumn("payload_hex", F.lower("payload_hex"))


@job("encode_packet", "event_id bigint, packet_hex string, field_mask bigint, clamped string, "
     "encode_error string")
def encode_packet(spark, sf):
    return packets.encode_packets(i.typed(spark, sf)).select(
        "event_id", hex_text(F.col("packet")).alias("packet_hex"), "field_mask",
        F.array_join("clamped", ",").alias("clamped"), "encode_error")


@job("decode_packet", f"event_id bigint, reject_reason string, {DECODED_SHAPE}")
def decode_packet(spark, sf):
    return packets.decode_packets(i.corrupted(spark, sf))


@job("batch_build", "session_id bigint, tick bigint, n_packets bigint, frame_bytes bigint, "
     "build_error string, frame_hex string")
def batch_build(spark, sf):
    due = i.packets(spark, sf).withColumn("tick", F.floor(F.col("t_us") / F.lit(i.HOUR_US)))
    return batches.build_batches(due, ["session_id", "tick"], ["event_id"]).withColumn(
        "frame_hex", hex_text(F.col("frame")))


@job("batch_split", "event_id bigint, element_pos bigint, reject_reason string, "
     "element_hex string")
def batch_split(spark, sf):
    return batches.split_batches(i.split_frames(spark, sf)).withColumn(
        "element_hex", hex_text(F.col("packet")))


def decoded_lines(spark, sf):
    return lines.decode_lines(lines.payload_lines(i.rx_packets(spark, sf)))


LINE_SHAPE = ("event_id bigint, origin string, element_pos bigint, reject_reason string, "
              "msg_type string, device_id bigint, seq bigint, packet_ts bigint, "
              "field_mask bigint, voltage_mv double, motor_temp_c double, soc_pct double, "
              "pv_voltage_v double, text string, text_kind string, num string")


@job("decode_line", LINE_SHAPE)
def decode_line(spark, sf):
    return decoded_lines(spark, sf).withColumn("num", pairs_text("num", 1000))


@job("ascii_events", "event_id bigint, text string, text_kind string, num string, str string, "
     "payload_hex string")
def ascii_events(spark, sf):
    return lines.ascii_events(i.ascii_payloads(spark, sf)).withColumns({
        "num": pairs_text("num", 1000), "str": pairs_text("str")})


# ------------------------------------------------------------------ captures

@job("vedirect_blocks", "session_id bigint, block_no bigint, end_line bigint, n_lines bigint, "
     "n_text_lines bigint, byte_sum_mod bigint, ok boolean, fields string")
def vedirect_blocks(spark, sf):
    blocks = shunt_text.text_blocks(i.shunt_lines(spark, sf), S)
    return blocks.withColumn("fields", pairs_text("fields", skip=("Checksum",)))


SHUNT_KEYS = ("V", "I", "P", "SOC", "Alarm", "AR", "H1", "H2")


@job("vedirect_frames", f"session_id bigint, end_block bigint, "
     f"{many([k.lower() for k in SHUNT_KEYS], 'string')}")
def vedirect_frames(spark, sf):
    frames = shunt_text.text_frames(shunt_text.text_blocks(i.shunt_lines(spark, sf), S), S)
    return frames.select("session_id", "end_block", *[
        F.try_element_at("fields", F.lit(k)).alias(k.lower()) for k in SHUNT_KEYS])


@job("missing_block_runs", "session_id bigint, first_block bigint, last_block bigint, "
     "n_blocks bigint, missing_keys string, have_keys string")
def missing_block_runs(spark, sf):
    runs = shunt_text.missing_block_runs(shunt_text.text_blocks(i.shunt_lines(spark, sf), S), S)
    return runs.withColumns({
        "missing_keys": F.array_join("missing_keys", ","),
        "have_keys": F.array_join(F.array_remove("have_keys", "Checksum"), ",")})


@job("vedirect_health", "session_id bigint, window_s bigint, lines bigint, blocks bigint, "
     "checksum_failures bigint")
def vedirect_health(spark, sf):
    return shunt_text.text_health(i.shunt_lines(spark, sf), S)


@job("modbus_replies", "k bigint, start bigint, reject_reason string, n_regs bigint, "
     "reg_sum bigint, first_reg bigint, last_reg bigint")
def modbus_replies(spark, sf):
    got = registers.register_replies(i.replies(spark, sf))
    regs = F.col("registers")
    return got.select(
        "k", "start", "reject_reason",
        F.when(regs.isNotNull(), F.size(regs)).alias("n_regs"),
        F.aggregate(regs, F.lit(0).cast("long"), lambda a, x: a + x).alias("reg_sum"),
        F.get(regs, F.lit(0)).alias("first_reg"),
        F.get(regs, F.size(regs) - 1).alias("last_reg"))


@job("modbus_snapshot", "k bigint, n_registers bigint, reg_sum bigint, soc bigint, "
     "missing string")
def modbus_snapshot(spark, sf):
    snap = registers.register_snapshot(
        registers.register_replies(i.replies(spark, sf, again=True)), ["k"], "reply_no")
    return snap.select(
        "k", F.size("registers").alias("n_registers"),
        F.aggregate(F.map_values("registers"), F.lit(0).cast("long"), lambda a, x: a + x)
        .alias("reg_sum"),
        F.try_element_at("registers", F.lit(21)).alias("soc"),
        F.array_join(normalize.missing_registers(F.col("registers")), ",").alias("missing"))


@job("can_frames", "event_id bigint, can_id bigint, kind string, mppt_index bigint, "
     "packet_id bigint, dlc bigint, data_hex string, passes_filter boolean")
def can_frames(spark, sf):
    return captures.bus_frames(i.bus(spark, sf)).withColumns({
        "data_hex": hex_text(F.col("data")),
        "passes_filter": captures.id_filter(dim.POWER_IDS)})


@job("rtd_conversions", "event_id bigint, raw_code bigint, fault_status bigint, "
     "reject_reason string")
def rtd_conversions(spark, sf):
    return captures.sensor_conversions(i.conversions(spark, sf))


@job("modem_reply_class", "send_id bigint, lines bigint, is_error boolean, "
     "needs_reset boolean, send_failed boolean")
def modem_reply_class(spark, sf):
    e = i.events(spark, sf)
    line = F.expr(
        "CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'at_error ' || c "
        "WHEN 'purchase' THEN 'Attention:take effect after atz' "
        "WHEN 'signup' THEN CASE c % 4 WHEN 0 THEN 'rx Timeout' WHEN 1 THEN 'no ack' "
        "WHEN 2 THEN 'Send Failed' ELSE 'err' END ELSE 'unknown command' END")
    replies = e.select(F.floor(F.col("event_id") / 3).alias("send_id"), line.alias("line"))
    return captures.reply_outcome(replies, ["send_id"])


# ------------------------------------------------------------------ normalisers

def shunt_maps(spark, sf):
    e = i.readings(spark, sf)
    pairs = {
        "V": "CASE WHEN event_id % 17 = 0 THEN '' ELSE cast(voltage_mv as string) END",
        "I": "CASE WHEN event_id % 19 = 0 THEN concat(' +', c, ' ') "
             "ELSE cast(current_ma as string) END",
        "P": "CASE WHEN event_id % 23 = 0 THEN '12.5' ELSE cast(power_w as string) END",
        "SOC": "CASE WHEN event_id % 13 = 0 THEN '---' ELSE cast((c * 3) % 1001 as string) END",
        "Alarm": "CASE WHEN event_id % 4 = 0 THEN cast(c % 5 as string) ELSE 'OFF' END",
        "AR": "CASE WHEN event_id % 6 = 1 THEN 'x' ELSE cast(alarm as string) END",
    }
    columns = [c for k, v in pairs.items() for c in (F.lit(k), F.expr(v))]
    return e.select("event_id", "t_us", "session_id", F.create_map(*columns).alias("fields"))


@job("normalize_bmv", "event_id bigint, voltage_mv bigint, current_ma bigint, power_w bigint, "
     "charge_state double, alarm bigint")
def normalize_bmv(spark, sf):
    return normalize.bmv(shunt_maps(spark, sf))


BMS_SHAPE = ("battery_voltage_v double, battery_current_a double, soc_pct bigint, "
             "soh_pct bigint, remaining_ah double, full_capacity_ah double, "
             "cycle_count bigint, temp_max_c bigint, cell_count bigint, cell_v_max_mv bigint, "
             "cell_v_min_mv bigint, cell_v_delta_mv bigint, cell_max_idx bigint, "
             "cell_min_idx bigint, cell_sum_v double")


@job("normalize_bms", f"k bigint, reject_reason string, {BMS_SHAPE}, cells string, "
     "unidentified string")
def normalize_bms(spark, sf):
    return normalize.bms(i.snapshots(spark, sf)).withColumns({
        "cells": F.array_join("cells_mv", ","),
        "unidentified": F.array_join(F.transform(
            F.array_sort(F.map_entries("unidentified")),
            lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))),
            ";")})


@job("cell_stats", "vec_id bigint, pack bigint, fitted bigint, cell_v_max_mv bigint, cell_v_min_mv bigint, "
     "cell_v_delta_mv bigint, cell_max_idx bigint, cell_min_idx bigint, cell_sum_v double")
def cell_stats(spark, sf):
    """Four packs of sixteen cells from each vector."""
    cells = F.expr(
        "transform(slice(embedding, 16 * pack + 1, 16), (x, i) -> CASE WHEN vec_id % 7 = 0 "
        "AND i = 4 THEN 0 ELSE cast(floor(3300 + cast(x as double) * 100) as int) END)")
    packs = i.table(spark, sf, "embeddings").withColumn("pack", F.explode(F.array(
        *[F.lit(n) for n in range(4)]))).select("vec_id", "pack", cells.alias("cells_mv"))
    return normalize.with_cell_stats(packs)


MPPT_SHAPE = ("device_id bigint, mppt_index bigint, packet_id bigint, reject_reason string, "
              "pv_voltage_v double, pv_current_a double, pv_power_w double, "
              "battery_voltage_v double, battery_current_a double, mode double, "
              "mode_name string, fault double, fault_name string, enabled double, "
              "ambient_temp_c double, heatsink_temp_c double, raw_hex string")


@job("normalize_mppt", f"event_id bigint, {MPPT_SHAPE}")
def normalize_mppt(spark, sf):
    return normalize.mppt(i.bus(spark, sf))


@job("normalize_rtd", "event_id bigint, raw_code bigint, fault bigint, fault_name string, "
     "resistance_ohm double, motor_temp_c double, motor_temp_f double")
def normalize_rtd(spark, sf):
    good = captures.sensor_conversions(i.conversions(spark, sf)).where("reject_reason is null")
    return normalize.rtd(good)


@job("quality_rules", "k bigint, violations string")
def quality_rules(spark, sf):
    checked = normalize.with_quality(normalize.bms(i.snapshots(spark, sf)))
    return checked.withColumn("violations", F.array_join("violations", "; "))


@job("register_profile", "reg bigint, label string, polls bigint, u16_min bigint, "
     "u16_max bigint, s16_min bigint, s16_max bigint, u16_sum bigint, hex_max string, "
     "ascii_polls bigint, ascii_max string")
def register_profile(spark, sf):
    return registers.register_profile(i.snapshots(spark, sf).select("k", "registers"))


# ------------------------------------------------------------------ events and points

def decoded_events(spark, sf):
    """Packets of the mapped sources and a text event for each unmapped one."""
    decoded = packets.decode_packets(i.packets(spark, sf)).drop("packet", "reject_reason")
    texts = i.events(spark, sf).where("event_type = 'error'").select(
        "event_id", "t_us", "session_id", F.expr(f.RECEIVED).alias("received_us"),
        F.encode(F.expr(
            "CASE event_id % 2 WHEN 0 THEN concat('hello-', c) ELSE concat('temp=', c) END"),
            "UTF-8").alias("payload"))
    texts = lines.ascii_events(texts).drop("payload").withColumn("msg_type", F.lit("ASCII"))
    return decoded.unionByName(texts, allowMissingColumns=True)


@job("influx_points", "event_id bigint, measurement string, bucket string, tags string, "
     "num string, str string, time_us bigint")
def influx_points(spark, sf):
    shaped = points.event_points(
        decoded_events(spark, sf), tags={"source": "receiver", "port": "p0"})
    return points.route(shaped).withColumns({
        "tags": pairs_text("tags"), "num": pairs_text("num", 10_000), "str": pairs_text("str")})


@job("flatten_event", "k bigint, path string, num double, str string")
def flatten_event(spark, sf):
    """Battery readings with their lists and maps, value by value."""
    packs = normalize.with_quality(normalize.bms(i.snapshots(spark, sf))).select(
        "k", F.struct("soc_pct", "cells_mv", "violations", F.create_map(
            F.lit("raw"), F.struct("unidentified")).alias("more")).alias("event"))
    return points.unnested(packs, "event", ["k"])


@job("format_packet_line", "event_id bigint, line string")
def format_packet_line(spark, sf):
    return points.packet_lines(packets.decode_packets(i.packets(spark, sf)))


@job("union_all_types", "event_id bigint, msg_type string, event_type string, "
     f"device_id bigint, seq bigint, packet_ts bigint, {many(FIELDS, 'double')}")
def union_all_types(spark, sf):
    return files.union_types(decoded_events(spark, sf), keep=["event_id"]).where(
        "packet_ts is not null")


# ------------------------------------------------------------------ ordered analyses

@job("asof_latest_at_tick", "session_id bigint, tick_us bigint, t_us bigint, "
     "staleness_s double, event_id bigint, current_ma bigint")
def asof_latest_at_tick(spark, sf):
    return sampling.latest_at_ticks(
        i.readings(spark, sf), i.ticks(spark, sf), S, ["event_id", "current_ma"],
        tie="event_id")


@job("drive_elapsed", "event_id bigint, session_id bigint, elapsed_s bigint")
def drive_elapsed(spark, sf):
    r = i.readings(spark, sf).withColumn(
        "current_a", F.col("current_ma").cast("double") / F.lit(1000.0))
    starts = sampling.drive_start(r, S, threshold_a=DRIVE_A)
    return sampling.stamp_elapsed(r, starts, S)


@job("peak_hold", "event_id bigint, session_id bigint, epoch bigint, tx_ok boolean, "
     "peak_current_ma bigint")
def peak_hold(spark, sf):
    return sampling.peak_hold(i.readings(spark, sf), S, ["t_us", "event_id"])


@job("seq_gap", "session_id bigint, msg_type string, arrival bigint, seq bigint, "
     "prev_seq bigint, gap bigint, lost bigint")
def seq_gap(spark, sf):
    return loss.sequence_gaps(i.received(spark, sf), S)


@job("running_loss", "session_id bigint, msg_type string, arrival bigint, lost bigint, "
     "received bigint, total_lost bigint, loss_pct double")
def running_loss(spark, sf):
    return loss.running_loss(i.received(spark, sf), S)


@job("session_loss", "session_id bigint, received bigint, lost bigint, loss_pct double")
def session_loss(spark, sf):
    return loss.session_loss(i.received(spark, sf), S)


@job("seq_assign", "event_id bigint, session_id bigint, msg_type string, seq bigint")
def seq_assign(spark, sf):
    e = i.events(spark, sf).withColumn("msg_type", F.upper("event_type"))
    return loss.assign_sequence(e, ["session_id", "msg_type"], ["t_us", "event_id"])


@job("tx_stats", "session_id bigint, stream string, window_s bigint, n_ok bigint, "
     "n_failed bigint")
def tx_stats(spark, sf):
    sends = i.readings(spark, sf).select(
        "session_id", F.col("event_type").alias("stream"), "t_us", F.col("tx_ok").alias("ok"))
    return health.send_stats(sends, ["session_id", "stream"])


@job("poll_health", "session_id bigint, stream string, window_s bigint, n_ok bigint, "
     "n_failed bigint, n_fault bigint, last_error string")
def poll_health(spark, sf):
    return health.poll_health(i.poll_log(spark, sf), ["session_id", "stream"], seconds=3600)


@job("poll_error_runs", "poll_id bigint, session_id bigint, stream string, "
     "consecutive bigint, backoff_s double, gives_up boolean")
def poll_error_runs(spark, sf):
    return health.error_runs(
        i.poll_log(spark, sf), ["session_id", "stream"], ["t_us", "poll_id"], give_up=3)


def pending(spark, sf):
    priority = F.expr("CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 5 "
                      "WHEN 'signup' THEN 7 ELSE 10 END")
    return i.events(spark, sf).select(
        "session_id", F.floor(F.col("t_us") / F.lit(24 * i.HOUR_US)).alias("tick"),
        priority.alias("priority"), F.col("event_id").alias("arrival"))


@job("priority_rank", "session_id bigint, tick bigint, priority bigint, arrival bigint, "
     "send_rank bigint, is_next boolean")
def priority_rank(spark, sf):
    due = pending(spark, sf)
    keys = ["session_id", "tick"]
    first = assembly.next_to_send(due, keys).select(
        *keys, F.col("arrival").alias("_first"))
    return assembly.priority_rank(due, keys).join(first, keys).withColumn(
        "is_next", F.col("arrival") == F.col("_first"))


def due_slots(spark, sf):
    return i.events(spark, sf).select(
        "session_id", F.floor(F.col("t_us") / F.lit(6 * i.HOUR_US)).alias("tick"),
        (F.col("user_id") % 7).cast("int").alias("slot"),
        F.expr("cast(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 20 + c % 50 END as int)")
        .alias("packet_bytes"))


@job("batch_assembly", "session_id bigint, tick bigint, frame_pos bigint, slot bigint, "
     "packet_bytes bigint")
def batch_assembly(spark, sf):
    return assembly.pick_batches(due_slots(spark, sf), S, slots=7)


# ------------------------------------------------------------------ send policies

def band_readings(spark, sf):
    return i.readings(spark, sf).withColumn(
        "flag", F.expr("CASE WHEN event_id % 16 <> 0 THEN 1 END"))


@job("deadband_generic", "event_id bigint, session_id bigint, device_id bigint, "
     "event_type string, prev_t_us bigint")
def deadband_generic(spark, sf):
    return send_policy.deadband(band_readings(spark, sf).drop("event_type"), BAND, D,
                                ["t_us", "event_id"])


@job("classify_bmv", "event_id bigint, session_id bigint, device_id bigint, "
     "event_type string, prev_t_us bigint")
def classify_bmv(spark, sf):
    r = i.readings(spark, sf).drop("event_type").withColumn(
        "charge_state", F.floor(F.col("charge_state") / 40) + F.col("charge_state") / 1000)
    return send_policy.classify_shunt(r, SHUNT, D, ["t_us", "event_id"])


@job("heartbeat", "event_id bigint, session_id bigint, device_id bigint, event_type string, "
     "prev_t_us bigint")
def heartbeat(spark, sf):
    return send_policy.heartbeat(i.readings(spark, sf).drop("event_type"), BEAT_S, D,
                                 ["t_us", "event_id"])


@job("commit_on_success", "event_id bigint, session_id bigint, device_id bigint, "
     "event_type string, prev_t_us bigint, tx_ok boolean, seq bigint")
def commit_on_success(spark, sf):
    """Every attempt takes the next number of its session, a failed one too."""
    tried = send_policy.deadband(band_readings(spark, sf).drop("event_type"), BAND, D,
                                 ["t_us", "event_id"], ok="tx_ok")
    return loss.assign_sequence(tried, S, ["t_us", "event_id"])


@job("status_throttle", "event_id bigint, session_id bigint, can_id bigint, prev_t_us bigint")
def status_throttle(spark, sf):
    status = captures.bus_frames(i.bus(spark, sf)).where("packet_id = 1")
    return send_policy.status_throttle(
        status, ["session_id", "can_id"], ["t_us", "event_id"], STATUS_S)


def found_violations(spark, sf):
    """What the quality rules find, a poll a minute. A plain ``posexplode`` would make Spark
    filter by the size of the list first: at the scan, with the normaliser spelled out once
    more for every use of a value."""
    checked = normalize.with_quality(normalize.bms(i.snapshots(spark, sf)))
    return checked.select(
        "k", (F.col("k") % 8).alias("session_id"), (F.col("k") * 60_000_000).alias("t_us"),
        F.posexplode_outer("violations").alias("nth", "rule")).where("rule is not null")


@job("rate_limited_warnings", "k bigint, session_id bigint, rule string, prev_t_us bigint")
def rate_limited_warnings(spark, sf):
    """One warning per spacing is reported."""
    return send_policy.rate_limited_warnings(  # few rows, and costly to find
        materialise(found_violations(spark, sf), "violations"), S, ["t_us", "nth"], WARNING_S,
        keep=["k", "rule"])


# ------------------------------------------------------------------ sinks

BMV_CSV = ("timestamp", "device_id", *dim.DEVICE_CSV_COLUMNS["bmv"])


def shunt_rows(spark, sf):
    r = i.readings(spark, sf)
    starts = sampling.drive_start(
        r.withColumn("current_a", F.col("current_ma") / F.lit(1000.0)), S, threshold_a=DRIVE_A)
    r = sampling.stamp_elapsed(r, starts, S).withColumns({
        "device_type": F.lit("bmv"),
        "charge_state": F.when(F.expr("event_id % 3 <> 0"), F.col("charge_state"))})
    return files.device_rows(r, "bmv")


DEVICE_TEXT = ("mode_name", "fault_name", "raw_hex")
DEVICE_FIELDS = tuple(dict.fromkeys(c for names in dim.DEVICE_CSV_COLUMNS.values() for c in names))
DEVICE_SHAPE = "device_type string, timestamp string, device_id bigint, " + ", ".join(
    f"{c} {'string' if c in DEVICE_TEXT else 'double'}" for c in DEVICE_FIELDS)


def device_readings(spark, sf) -> dict[str, DataFrame]:
    """CSV rows of the four device types, from their normalisers."""
    bus = normalize.mppt(i.bus(spark, sf)).where("reject_reason is null")
    polls = i.snapshots(spark, sf).withColumns({
        "t_us": F.col("k") * 60_000_000, "device_id": F.col("k") % 8})
    # A filter on the reason itself would move below and build every register map twice.
    packs = normalize.bms(polls).withColumn("whole", F.explode_outer(F.array(
        F.col("reject_reason").isNull()))).where("whole").withColumn("device_type", F.lit("bms"))
    sensors = normalize.rtd(
        captures.sensor_conversions(i.conversions(spark, sf)).where("reject_reason is null"))
    return {"bmv": shunt_rows(spark, sf)} | {
        name: files.device_rows(rows, name)
        for name, rows in (("mppt", bus), ("bms", packs), ("rtd", sensors))}


@job("sink_device_csv", DEVICE_SHAPE)
def sink_device_csv(spark, sf):
    """A folder and a header for each device type; read back under one header."""
    base, found = run_dir(spark, "device-csv"), None
    for name, rows in device_readings(spark, sf).items():
        files.write_csv(rows, f"{base}/{name}")
        part = files.read_csv(spark, f"{base}/{name}", rows.columns).withColumn(
            "device_type", F.lit(name))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


@job("sink_event_csv", many(event_csv_columns(), "string"))
def sink_event_csv(spark, sf):
    path = run_dir(spark, "event-csv")
    files.write_csv(files.event_rows(decoded_events(spark, sf)), path)
    return files.read_csv(spark, path, event_csv_columns())


@job("sink_schema_rotation", "layout string, timestamp string, device_id string, "
     "voltage_mv string, alarm string")
def sink_schema_rotation(spark, sf):
    """The first half of the rows in an earlier layout, then the current one."""
    base = run_dir(spark, "rotation")
    rows = shunt_rows(spark, sf)
    earlier = ["timestamp", "device_id", "voltage_mv"]
    early = F.col("alarm") == "0"
    old = files.write_rotating(rows.where(early).select(*earlier), base)
    new = files.write_rotating(rows.where(~early), base)
    assert old != new
    return files.read_csv(spark, old, earlier).withColumn("layout", F.lit("old")).unionByName(
        files.read_csv(spark, new, BMV_CSV).withColumn("layout", F.lit("new")),
        allowMissingColumns=True)


@job("sink_routed", "event_id bigint, msg_type string, bucket string")
def sink_routed(spark, sf):
    path = run_dir(spark, "routed")
    files.write_routed(decoded_events(spark, sf).select("event_id", "msg_type"), path)
    return spark.read.parquet(path)


@job("sink_line_protocol", "value string")
def sink_line_protocol(spark, sf):
    path = run_dir(spark, "points")
    files.write_points(decoded_events(spark, sf), path, tags={"source": "receiver"})
    return spark.read.text(path)


@job("fan_out", "sink string, ok boolean, error string, n_rows bigint, id_sum bigint")
def fan_out(spark, sf):
    """Three sinks of which one fails: outcomes, and what each one stored."""
    paths = {name: run_dir(spark, f"fan-{name}") for name in ("parquet", "routed")}

    def broken(df, batch_id):
        raise ValueError("sink is down")

    events = decoded_events(spark, sf).select("event_id", "msg_type")
    outcomes = files.fan_out(events, {
        "parquet": lambda df, _: df.write.parquet(paths["parquet"]),
        "broken": broken,
        "routed": lambda df, _: files.write_routed(df, paths["routed"]),
    })
    stored = None
    for name, path in paths.items():
        part = spark.read.parquet(path).select(F.lit(name).alias("sink"), "event_id")
        stored = part if stored is None else stored.unionByName(part)
    sums = stored.groupBy("sink").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("id_sum"))
    return outcomes.join(sums, "sink", "left")


# ------------------------------------------------------------------ streams

CLOSING = -1


BATCH_ROWS = 500_000        # a micro-batch; a longer input makes more of them


def stream_files(spark, df: DataFrame, name: str, order: str, parts: int = 4,
                 astray: int = 0) -> DataFrame:
    """Write the rows as files by ``order`` and open them as a stream.

    There are ``parts`` stretches, or more where these would hold over ``BATCH_ROWS`` rows.
    With ``astray`` a stretch is a file and a micro-batch, and a row may stand in an earlier
    or later one, as if it had been under way for longer or shorter by up to so much; a last
    file then closes the stream with one row of the session CLOSING, later than all by more
    than that. Without, no row depends on others: a stretch is a file a core, and as many
    files are a micro-batch, so that all cores work on it.
    """
    path, staged = run_dir(spark, name), run_dir(spark, f"{name}-staged")
    rows = materialise(df, f"{name}-rows")
    found = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"),
                     F.count(F.lit(1)).alias("n")).first()
    low, high = found["lo"] or 0, found["hi"] or 0
    parts = max(parts, -(-found["n"] // BATCH_ROWS))
    width = max(1, -(-(high - low + 1) // parts))
    digest = F.xxhash64(*df.columns)
    under_way = F.pmod(digest, F.lit(astray + 1)) if astray else F.lit(0)
    place = F.least(F.floor((F.col(order) - low + under_way) / width), F.lit(parts - 1))
    files = 1 if astray else spark.sparkContext.defaultParallelism
    (rows.withColumn("part", place)
     .repartition(min(parts * files, 2_000), "part", F.pmod(digest, F.lit(files)))
     .write.partitionBy("part").parquet(path if not astray else staged))
    if astray:
        dealt = spark.read.schema(f"{ddl(df)}, part bigint").parquet(staged)
        for part in range(parts):  # a stream takes files in the order they were written
            dealt.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(
                f"{path}/part={part}")
        df.sparkSession.range(1).select(*[
            F.lit({"session_id": CLOSING, order: high + 2 * astray + 2_000_000}.get(f.name))
            .cast(f.dataType).alias(f.name) for f in df.schema]).coalesce(1).write.parquet(
            f"{path}/part={parts}")
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files)
            .parquet(f"{path}/part=*"))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def drained(spark, stream: DataFrame, name: str) -> DataFrame:
    out = run_dir(spark, f"{name}-out")
    streams.run_available(stream, out, run_dir(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


@job("streaming_decode", LINE_SHAPE)
def streaming_decode(spark, sf):
    source = stream_files(spark, i.rx_packets(spark, sf), "rx", "t_us")
    got = drained(spark, streams.decode_stream(source), "decode")
    return got.withColumn("num", pairs_text("num", 1000))


LOG_LINES = "session_id bigint, line_no bigint, line string"


def log_chunks(spark, sf):
    """The modem's output per session as it was read: chunks that end anywhere."""
    text = F.encode(F.concat(
        F.translate("raw", "\n", "|"), F.when(F.col("event_id") % 3 == 0, "é").otherwise(""),
        F.when(F.col("event_id") % 5 == 0, "").otherwise("\n")), "UTF-8")
    raw = i.rx_raw(spark, sf).join(i.events(spark, sf).select("event_id", "session_id"),
                                   "event_id").withColumn("raw", text)
    size = F.length("raw")
    at = F.when(F.col("event_id") % 3 == 0, size - 2).otherwise(
        F.pmod(F.col("event_id"), size + 1)).cast("int")  # often inside the two-byte letter
    halves = F.array(F.substring(F.col("raw"), F.lit(1), at),
                     F.substring(F.col("raw"), at + 1, size))
    return raw.select("session_id", F.posexplode(halves).alias("half", "raw"),
                      "event_id").select(
        "session_id", (F.col("event_id") * 2 + F.col("half")).alias("chunk_no"), "raw")


@job("scan_rx_lines", LOG_LINES)
def scan_rx_lines(spark, sf):
    path = run_dir(spark, "log")
    log_chunks(spark, sf).write.parquet(path)
    return captures.reassembled_lines(spark.read.parquet(path), S, ["chunk_no"])


@job("streaming_scan_rx_lines", LOG_LINES)
def streaming_scan_rx_lines(spark, sf):
    """The same from files that a chunk may reach early or late; a chunk counts as a second."""
    rows = log_chunks(spark, sf).withColumn("at_us", (F.col("chunk_no") + 1) * 1_000_000)
    source = stream_files(spark, rows, "log", "at_us", astray=100_000_000)
    got = drained(spark, streams.line_stream(source, S, ["at_us", "chunk_no"], delay_s=100), "log")
    return got.where(F.col("session_id") != CLOSING)


@job("reject_table", "event_id bigint, stage string, element_pos bigint, reject_reason string")
def reject_table(spark, sf):
    """Rejects of all micro-batches; the second one is handed over twice."""
    base = run_dir(spark, "sides")
    shape = "event_id bigint, stage string, element_pos int, reject_reason string"

    def write(df, batch_id):
        sides = rejects.decode_stage(df).select(
            *[F.col(c).cast(k).alias(c) for c, k in (x.split(" ") for x in shape.split(", "))])
        for _ in range(1 + (batch_id == 1)):
            rejects.write_sides(sides, base, batch_id)

    source = stream_files(spark, i.rx_packets(spark, sf), "rx", "t_us")
    streams.run_batches(streams.decode_stream(source), write, run_dir(spark, "sides-state"))
    return rejects.read_side(spark, base, rejects.REJECTS, shape)


@job("streaming_seq_gap", "session_id bigint, msg_type string, arrival bigint, seq bigint, "
     "prev_seq bigint, gap bigint, lost bigint")
def streaming_seq_gap(spark, sf):
    """Packets out of order by up to 200 arrivals; an arrival counts as a second."""
    rows = i.received(spark, sf).withColumn("at_us", (F.col("arrival") + 1) * 1_000_000)
    source = stream_files(spark, rows, "packets", "at_us", astray=200_000_000)
    got = drained(spark, streams.gap_stream(source, S, ["at_us", "arrival"], 200), "gaps")
    return got.where(F.col("session_id") != CLOSING)


@job("streaming_deadband", "event_id bigint, session_id bigint, device_id bigint, "
     "event_type string, prev_t_us bigint")
def streaming_deadband(spark, sf):
    """Readings out of order by up to a day."""
    day = 24 * i.HOUR_US
    rows = band_readings(spark, sf).select(*D, "t_us", "event_id", *BAND.deltas)
    source = stream_files(spark, rows, "readings", "t_us", astray=day)
    got = drained(spark, streams.deadband_stream(
        source, BAND, D, ["t_us", "event_id"], day / 1e6), "band")
    return got.where(F.col("session_id") != CLOSING)


@job("streaming_heartbeat", "session_id bigint, sent_us bigint, event_type string, "
     "t_us bigint, event_id bigint")
def streaming_heartbeat(spark, sf):
    """Sessions send every two days, also those that are heard no more."""
    day = 24 * i.HOUR_US
    rows = i.readings(spark, sf).where("session_id <> 3 or event_id % 5 = 0").select(
        *S, "t_us", "event_id")
    last = rows.agg(F.max("t_us")).first()[0]
    source = stream_files(spark, rows, "beats", "t_us", astray=day)
    got = drained(spark, streams.heartbeat_stream(
        source, BEAT_S, S, ["t_us", "event_id"], day / 1e6), "beats")
    return got.where((F.col("session_id") != CLOSING) & (F.col("sent_us") <= last))


# ------------------------------------------------------------------ hot keys

def cut(job_of: Job, limit: int) -> Job:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with cut_at(limit, most_slices=32):
            return job_of(spark, sf_dir)

    return run


#: Ordered jobs once more, with keys of more rows than this cut into slices.
CUT = {"seq_gap": 100, "running_loss": 300, "session_loss": 100, "seq_assign": 100,
       "peak_hold": 300, "asof_latest_at_tick": 300, "poll_error_runs": 100,
       "deadband_generic": 12, "classify_bmv": 12, "heartbeat": 12, "commit_on_success": 12,
       "status_throttle": 20, "rate_limited_warnings": 100}
for _name, _limit in CUT.items():
    JOBS[f"{_name}_cut"], SHAPES[f"{_name}_cut"] = cut(JOBS[_name], _limit), SHAPES[_name]
