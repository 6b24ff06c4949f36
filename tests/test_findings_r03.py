"""Cases of the third round's findings."""

import glob
import os

from pyspark.sql import functions as F

from fieldstream.operators import points, timeline
from fieldstream.sources import shunt_text
from fieldstream.session import shared_dir
from workload import inputs, jobs

SF = "/root/testdata/sf0.001"


def filters(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter" in line]


def test_violations_are_not_worked_out_to_filter_the_scan(spark):
    found = jobs.found_violations(spark, SF)
    assert found.where("rule is null").isEmpty() and not found.isEmpty()
    assert not [x for x in filters(found) if "size(" in x]


def test_nested_values_are_not_worked_out_to_filter_the_scan(spark):
    df = spark.createDataFrame([(1, [7, 8]), (2, []), (3, None)], "k int, a array<int>")
    got = points.unnested(df.select("k", F.struct("a").alias("event")), "event", ["k"])
    assert not [x for x in filters(got) if "size(" in x]
    assert sorted(tuple(x) for x in got.collect()) == [
        (1, "a_0", 7.0, None), (1, "a_1", 8.0, None)]


def test_numbers_of_a_point_have_no_exponent(spark):
    values = [-0.0005, 0.0001, 12345678.5, 0.00012345678901234567, 3.0, 1e-5, 2.5]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [x[0] for x in df.select(points._number_text(F.col("x"))).collect()]
    assert got == ["-0.0005", "0.0001", "12345678.5", "0.00012345678901234567", "3.0",
                   "1.0E-5", "2.5"]


def test_a_longer_time_line_is_dealt_into_more_tasks(spark):
    df = spark.range(2000).withColumn("k", F.lit(1))
    line = timeline.Timeline(df, ["k"], ["id"], limit=40)
    assert line.sorted_parts([]).rdd.getNumPartitions() == 100
    assert line.scan(n=("count", F.lit(1))).rows.rdd.getNumPartitions() == 100
    assert timeline.Timeline(df, ["k"], ["id"]).tasks is None


def test_blocks_of_a_cut_session_are_worked_out_once(spark):
    with timeline.cut_at(100, most_slices=16):
        lines = inputs.shunt_lines(spark, SF)
        blocks = shunt_text.text_blocks(lines, ["session_id"])
        frames = shunt_text.text_frames(blocks, ["session_id"])
        health = shunt_text.text_health(lines, ["session_id"])
    for df in (frames, health):
        assert "EvalPython" not in df._jdf.queryExecution().optimizedPlan().toString()
    whole = shunt_text.text_health(lines, ["session_id"])
    assert sorted(health.collect()) == sorted(whole.collect())


def test_a_longer_stream_has_more_batches(spark, monkeypatch):
    monkeypatch.setattr(jobs, "BATCH_ROWS", 250)
    got = jobs.JOBS["streaming_scan_rx_lines"](spark, SF)
    assert sorted(got.collect()) == sorted(jobs.JOBS["scan_rx_lines"](spark, SF).collect())
    logs = [x for x in glob.glob(f"{shared_dir(spark)}/fieldstream-log-*") if "part=8" in
            {os.path.basename(y) for y in glob.glob(f"{x}/*")}]
    parts = [spark.read.parquet(f"{logs[-1]}/part={n}").count() for n in range(8)]
    assert sum(parts) == 2000 and max(parts) < 500


def test_a_batch_without_order_has_a_file_a_core(spark):
    rows = spark.range(4000).select("id", F.lit(1).alias("session_id"))
    jobs.stream_files(spark, rows, "cores", "id")
    path = glob.glob(f"{shared_dir(spark)}/fieldstream-cores-????????????")[-1]
    files = [len(glob.glob(f"{path}/part={n}/*.parquet")) for n in range(4)]
    assert min(files) > 1 and spark.read.parquet(path).count() == 4000
