"""Cases that once gave wrong or cut results."""

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import normalize, points, sampling


def test_more_than_a_thousand_cells(spark):
    cells = [3300] * 1500
    cells[1200], cells[1400] = 3400, 3200
    row = normalize.with_cell_stats(
        spark.createDataFrame([(1, cells)], "id long, cells_mv array<int>")).first()
    assert (row["cell_v_max_mv"], row["cell_max_idx"]) == (3400, 1201)
    assert (row["cell_v_min_mv"], row["cell_min_idx"]) == (3200, 1401)


def test_flatten_refuses_or_keeps_arrays(spark):
    df = spark.createDataFrame([(1, [7, 8])], "a int, b array<int>")
    with pytest.raises(ValueError):
        points.flatten(df)
    flat = points.flatten(df, max_items=2)
    assert df.select(*[c.alias(n) for n, c in flat.items()]).first().asDict() == {
        "a": 1, "b_0": 7, "b_1": 8}


def test_as_of_ties_do_not_depend_on_the_input_order(spark):
    rows = [(1, 10, 1), (1, 10, 2), (1, 5, 3)]
    ticks = spark.createDataFrame([(1, 20)], "k int, tick_us long")
    got = {
        sampling.latest_at_ticks(
            spark.createDataFrame(order, "k int, t_us long, event_id long"), ticks, ["k"],
            ["event_id"], tie="event_id").first()["event_id"]
        for order in (rows, rows[::-1])}
    assert got == {2}


def test_line_ends_stay_inside_a_point(spark):
    df = spark.createDataFrame(
        [("m", {"t": "x"}, {"v": 1.0}, {"s": "a\nb"}, 5)],
        "measurement string, tags map<string,string>, num map<string,double>, "
        "str map<string,string>, time_us long")
    assert points.line_protocol(df).select(F.col("value")).first()[0] == (
        'm,t=x v=1.0,s="a\\nb" 5000')
