from pyspark.sql import functions as F

from fieldstream.functions import binary as b
from fieldstream.operators import normalize
from fieldstream.plans import dimensions as dim
from fieldstream.sources import captures, registers, shunt_text


def block(*pairs, wrong=0):
    lines = [f"{k}\t{v}\r\n".encode("latin-1") for k, v in pairs] + [b"Checksum\t"]
    tail = b"\r\n"
    check = (-sum(map(sum, lines)) - sum(tail) + wrong) % 256
    lines[-1] += bytes([check]) + tail
    return lines


def capture(spark, blocks):
    raw = [line for lines in blocks for line in lines]
    return spark.createDataFrame(
        [(1, n, line) for n, line in enumerate(raw)], "session_id int, line_no long, raw binary")


def fields(row):
    return {k: v for k, v in row["fields"].items() if k != "Checksum"}


def test_text_blocks_and_frames(spark):
    df = capture(spark, [
        block(("V", 1), ("I", 2)), [b"noise\r\n"] + block(("P", 9), wrong=1),
        block(("P", 3), ("V", 5)), block(("H1", 7)), block(("V", 1), ("I", 1), ("P", 1)),
        block(("H2", 8)), [b"V\t77\r\n"],
    ])
    blocks = shunt_text.text_blocks(df, ["session_id"])
    # the noise line breaks its block's sum as well
    assert [r["ok"] for r in blocks.orderBy("block_no").collect()] == [
        True, False, True, True, True, True]
    frames = shunt_text.text_frames(blocks, ["session_id"]).orderBy("end_block").collect()
    assert [(r["end_block"], fields(r)) for r in frames] == [
        (2, {"V": "5", "I": "2", "P": "3"}),
        (4, {"H1": "7", "V": "1", "I": "1", "P": "1"})]
    assert shunt_text.missing_block_runs(blocks, ["session_id"]).count() == 0


def test_missing_runs(spark):
    df = capture(spark, [block(("V", 1)), block(("H1", 1)), block(("P", 1))])
    run = shunt_text.missing_block_runs(
        shunt_text.text_blocks(df, ["session_id"]), ["session_id"]).first()
    assert run["n_blocks"] == 3 and run["missing_keys"] == ["I"]
    assert [k for k in run["have_keys"] if k != "Checksum"] == ["H1", "P", "V"]


def reply(spark, body, count=2, keep_crc=True):
    df = spark.createDataFrame([(1, 3, 10, count, body)],
                               "address int, func int, start int, count int, body binary")
    frame = b.with_modbus_crc(F.col("body")) if keep_crc else F.col("body")
    return registers.register_replies(df.withColumn("frame", frame)).first()


def test_register_replies(spark):
    good = reply(spark, b"\x01\x03\x04\x00\x07\xff\xfe")
    assert good["reject_reason"] is None and good["registers"] == [7, 0xFFFE]
    for body, reason in ((b"\x02\x03\x04\x00\x07\x00\x08", "wrong address"),
                         (b"\x01\x83\x02", "exception reply"),
                         (b"\x01\x04\x04\x00\x07\x00\x08", "unexpected function"),
                         (b"\x01\x03\x06\x00\x07\x00\x08", "byte count"),
                         (b"\x01\x03\x04\x00\x07", "byte count")):
        assert reply(spark, body)["reject_reason"] == reason
    assert reply(spark, b"\x01\x03", keep_crc=False)["reject_reason"] == "response too short"
    assert reply(spark, b"\x01\x03\x02\x00\x07\x00\x00", keep_crc=False)[
        "reject_reason"] == "crc mismatch"


def test_snapshot_drops_failed_polls_and_merges_overlaps(spark):
    df = spark.createDataFrame(
        [(1, 0, [1, 2, 3], None), (1, 2, [9], None), (2, 0, [5], None), (2, 8, None, "crc")],
        "poll int, start int, registers array<int>, reject_reason string")
    got = registers.register_snapshot(df, ["poll"]).collect()
    assert [(r["poll"], r["registers"]) for r in got] == [(1, {0: 1, 1: 2, 2: 9})]


def test_battery_golden(spark):
    regs = {21: 85, 22: 5316, 23: 0, 24: 37, 26: 8500, 27: 10000, 30: 7, 32: 100, 41: 16, 19: 5}
    regs.update({113 + i: 3323 if i < 8 else 3322 for i in range(16)})
    regs[128] -= 0
    df = spark.createDataFrame([(1, regs)], "k int, registers map<int,int>")
    row = normalize.with_quality(normalize.bms(df)).first()
    assert (row["soc_pct"], row["battery_voltage_v"], row["battery_current_a"]) == (85, 53.16, 0.0)
    assert (row["remaining_ah"], row["full_capacity_ah"], row["cycle_count"]) == (85.0, 100.0, 7)
    assert (row["cell_v_max_mv"], row["cell_v_min_mv"], row["cell_v_delta_mv"]) == (3323, 3322, 1)
    assert (row["cell_max_idx"], row["cell_min_idx"], row["cell_sum_v"]) == (1, 9, 53.16)
    assert row["violations"] == [] and row["unidentified"] == {19: 5}
    regs.update({24: 65_535, 23: 65_436, 21: 101, **{113 + i: 0 for i in range(16)}})
    row = normalize.with_quality(normalize.bms(
        spark.createDataFrame([(1, regs)], "k int, registers map<int,int>"))).first()
    assert (row["temp_max_c"], row["battery_current_a"]) == (-1, -1.0)
    assert row["cell_v_max_mv"] is None
    assert row["violations"] == ["no cell voltages", "soc above 100"]
    del regs[26]
    assert normalize.bms(spark.createDataFrame([(1, regs)], "k int, registers map<int,int>")
                         ).first()["reject_reason"] == "missing registers 26"


def test_bus_frames(spark):
    rows = [(0x110, b"\x01\x00\xff\xff\x00\x01\x80\x00"), (0x011, b"\x07\x02\x01\x80"),
            (0x112, b""), (0x090, b"")]
    df = spark.createDataFrame([(n, i, False, d, False, False) for n, (i, d) in enumerate(rows)],
                               "n int, can_id int, extended boolean, data binary, "
                               "is_error boolean, is_remote boolean")
    assert captures.bus_frames(df).count() == 2 and captures.unmapped_frames(df).count() == 2
    got = {r["n"]: r for r in normalize.mppt(df, base_device=40).collect()}
    assert (got[0]["mppt_index"], got[0]["device_id"], got[0]["packet_id"]) == (0, 40, 0)
    assert (got[0]["pv_voltage_v"], got[0]["pv_current_a"]) == (2.56, -0.0005)
    assert got[0]["battery_current_a"] == -16.384
    assert (got[1]["device_id"], got[1]["mode_name"], got[1]["fault_name"]) == (
        41, "Unknown(7)", "Input Over Voltage")
    assert got[1]["heatsink_temp_c"] == 0.0 and got[1]["ambient_temp_c"] == -128.0
    assert got[1]["raw_hex"] == "0702018000000000"
    assert got[2]["reject_reason"] == got[3]["reject_reason"] == "unmapped can_id"
    assert sorted(dim.BUS_IDS) == sorted(
        r["can_id"] for r in dim.bus_id_table(spark).collect())


def test_sensor(spark):
    df = spark.createDataFrame(
        [(0x40, 0x00, 0xFF, 1, 1), (0x40, 0x01, 0x84, 1, 1), (0, 0, 0, 1, 1), (0, 0, 0, 1, 2)],
        "msb int, lsb int, fault_status int, config_expected int, config_read int")
    rows = captures.sensor_conversions(df).collect()
    assert [(r["raw_code"], r["fault_status"]) for r in rows[:3]] == [
        (8192, 0), (8192, 0x84), (0, 0)]
    assert rows[3]["reject_reason"] == "config mismatch"
    got = normalize.rtd(captures.sensor_conversions(df)).collect()
    assert got[0]["resistance_ohm"] == 107.5 and 19 < got[0]["motor_temp_c"] < 20
    assert got[1]["fault_name"] == "rtd_high|over_under_voltage"
    assert got[1]["motor_temp_c"] is None and got[2]["fault_name"] == "no_signal"


def test_register_dump(spark):
    df = spark.createDataFrame([(1, {21: 0x4142, 113: 0xFFFF, 5: 7})],
                               "k int, registers map<int,int>")
    got = {r["reg"]: r for r in registers.register_dump(df).collect()}
    assert (got[21]["hex"], got[21]["ascii_pair"], got[21]["label"]) == ("0x4142", "AB", "soc")
    assert (got[113]["s16"], got[113]["ascii_pair"], got[113]["label"]) == (-1, None, "cell 1")
    assert got[5]["label"] == ""
    assert registers.register_profile(df).count() == 3


def test_flatten_and_registry(spark):
    from fieldstream.operators import points
    from fieldstream.plans.components import SOURCES

    df = spark.sql("select 1 as a, named_struct('b', 2, 'c', array(3, 4)) as d")
    flat = points.flatten(df, max_items=2)
    assert list(flat) == ["a", "d_b", "d_c_0", "d_c_1"]
    assert tuple(df.select(*flat.values()).first()) == (1, 2, 3, 4)
    assert {s.msg_type for s in SOURCES.values()} == {"BMV", "BMS", "RTD", "MPPT"}
    assert points.packet_lines(
        df.withColumn("msg_type", F.lit("X")), {"X": lambda: F.lit("mine")}).first()["line"] == "mine"


def test_later_replies_are_laid_over_earlier_ones(spark):
    """Two input orders agree; a later reply wins where ranges overlap or repeat."""
    rows = [(1, 0, 0, [1, 2, 3, 4]), (1, 2, 1, [30, 40, 50]), (1, 0, 2, [10, 20, 300, 400]),
            (1, 3, 3, [9]), (2, 5, 1, [7]), (2, 5, 0, [6])]
    schema = "poll int, start int, nth int, registers array<int>"
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, schema).selectExpr("*", "cast(null as string) reject_reason")
        got = {r["poll"]: r["registers"]
               for r in registers.register_snapshot(df, ["poll"], "nth").collect()}
        assert got == {1: {0: 10, 1: 20, 2: 300, 3: 9, 4: 50}, 2: {5: 7}}
