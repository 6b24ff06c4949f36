"""Plans: what reaches the scan, and how many shuffles a job takes."""

from fieldstream.functions.binary import crc16_ccitt
from fieldstream.operators import loss, packets
from fieldstream.operators.timeline import Timeline
from fieldstream.sources import captures
from workload import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "frames")
    inputs.bus(spark, SF).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    text = plan(captures.bus_frames(spark.read.parquet(path)).select("event_id", "kind"))
    assert "In(can_id" in text.split("PushedFilters")[1] and "BroadcastHashJoin" in text
    assert "data:binary" not in text.split("ReadSchema")[1]


def test_gaps_take_one_shuffle(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "user_id % 8 session_id", "event_type msg_type", "event_id arrival",
        "cast(event_id % 9 as int) seq")
    text = plan(loss.sequence_gaps(df, ["session_id"]))
    assert text.count("Exchange hashpartitioning") == 1


def test_finer_keys_are_not_counted_again(spark):
    df = spark.range(50).selectExpr("id % 3 k", "id % 2 part", "id t", "id v")
    first = Timeline(df, ["k"], ["t"])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    Timeline(first.rows, ["k", "part"], ["t"])
    assert not tracker.getJobIdsForGroup("counted")
    Timeline(df, ["part"], ["t"])
    assert tracker.getJobIdsForGroup("counted")


def test_checksum_runs_once(spark):
    df = spark.createDataFrame([(b"123456789",)], "packet binary")
    checked = df.select("packet", crc16_ccitt("packet").alias("crc")).where("crc > 5")
    assert plan(checked).count("ArrowEvalPython") == 1
    decoded = packets.decoded_only(packets.decode_packets(df))
    assert plan(decoded).count("ArrowEvalPython") == 1
