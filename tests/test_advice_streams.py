"""Streams run in several micro-batches, so state has to cross them."""

import pytest

from fieldstream.streaming import jobs as streams
from workload.check import compare
from workload.jobs import JOBS
from workload.oracles import oracles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["streaming_seq_gap", "streaming_deadband",
                                  "streaming_heartbeat", "streaming_scan_rx_lines"])
def test_state_crosses_micro_batches(spark, monkeypatch, name):
    seen = []

    def counted(stream, out, checkpoint):
        query = (stream.writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
        seen.append(query.lastProgress["batchId"])

    monkeypatch.setattr(streams, "run_available", counted)
    assert compare(spark, SF, name, JOBS[name], oracles()[name])
    assert seen and seen[0] >= 3
