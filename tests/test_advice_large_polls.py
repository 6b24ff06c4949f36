"""Register polls and device rows at size: nothing is interpreted value by value."""

from pyspark.sql import functions as F

from fieldstream.functions import binary as b
from fieldstream.operators import normalize
from fieldstream.session import METHOD_BYTES, METHOD_CONF
from fieldstream.sources import registers
from workload import inputs, jobs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_polls_generate_no_method_that_is_only_interpreted(spark):
    before = spark.conf.get(METHOD_CONF)
    try:
        spark.conf.set(METHOD_CONF, "65535")
        inputs.polls(spark, SF)
        assert int(spark.conf.get(METHOD_CONF)) == METHOD_BYTES
    finally:
        spark.conf.set(METHOD_CONF, before)


def test_frames_and_snapshots_are_made_by_the_column(spark):
    replies = registers.register_replies(inputs.replies(spark, SF, again=True))
    assert "lambdafunction(lpad" not in plan(replies)
    laid = plan(registers.register_snapshot(replies, ["k"], "reply_no"))
    assert "flatten" not in laid and "map_from_entries" not in laid


def test_frames_of_words_and_checksum(spark):
    df = spark.createDataFrame(
        [(1, b"\x01\x03\x04", [258, -1]), (2, b"\x01\x83\x02", None), (3, b"", []),
         (4, None, [1]), (5, b"\x01\x03\x02", [65536 + 7])], "k int, head binary, words array<int>")
    got = {r.k: r.frame for r in df.select(
        "k", b.modbus_frame("head", "words").alias("frame")).collect()}
    bodies = spark.createDataFrame(
        [(1, b"\x01\x03\x04\x01\x02\xff\xff"), (2, b"\x01\x83\x02"), (3, b""),
         (5, b"\x01\x03\x02\x00\x07")], "k int, body binary")
    want = {r.k: r.frame for r in bodies.select(
        "k", b.with_modbus_crc(F.col("body")).alias("frame")).collect()}
    assert got == want | {4: None}


def test_later_runs_of_registers_win(spark):
    df = spark.createDataFrame(
        [("a", [5, 6, 5], [[1, 2, 3], [9], [7]]), ("b", [], []), ("c", [70000], [[4, None]])],
        "k string, starts array<int>, runs array<array<int>>")
    got = {r.k: r.m for r in df.select(
        "k", registers.laid_over("starts", "runs").alias("m")).collect()}
    assert got == {"a": {5: 7, 6: 9, 7: 3}, "b": {}, "c": {70000: 4, 70001: None}}


def test_device_rows_build_each_register_map_once(spark):
    lines = plan(jobs.device_readings(spark, SF)["bms"]).splitlines()
    assert not [x for x in lines if "Filter" in x and "array_except" in x]


def test_registers_are_looked_up_by_compiled_expressions(spark):
    maps = spark.createDataFrame(
        [(1, {113: 3300, 128: 3200, 19: 7, 40: None, 50: 1}), (2, {}), (3, None)],
        "k int, registers map<int,int>")
    read = normalize.bms(maps)
    text = plan(read)
    assert "map_filter" not in text and "sequence(113" not in text
    got = {r.k: (r.cells_mv, r.unidentified) for r in read.collect()}
    assert got == {1: ([3300, *[0] * 14, 3200], {19: 7, 40: None}), 2: ([0] * 16, {}),
                   3: ([0] * 16, None)}
