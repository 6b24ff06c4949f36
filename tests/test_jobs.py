"""Every registered job against its reference SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from workload.check import compare
from workload.jobs import JOBS
from workload.oracles import oracles

SF = "/root/testdata/sf0.001"
ORACLES = oracles()


def test_every_job_has_reference_sql():
    assert set(JOBS) == set(ORACLES)
    assert set(JOBS) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, name):
    assert compare(spark, SF, name, JOBS[name], ORACLES[name])


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["session_id", "received", "lost", "loss_pct"]
    assert frame.count() == 8
