import pytest
from pyspark.sql import functions as F

from fieldstream.functions import numeric, text
from fieldstream.operators import lines
from fieldstream.sources import captures


@pytest.mark.parametrize("line, expected", [
    ("Data: (HEX:) 01 a2 D1 59 ,-33,13", "01a2D159"),
    ("01 a2", None), (",-48,13", None), ("-48,13", None), ("b502aa", None),
    ("01 a2 b3 xyz c4", "01a2b3c4"), ("", None), ("01 é5a b3 c4", "01b3c4"),
])
def test_hex_payload(spark, line, expected):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(text.hex_payload(text.hex_tokens(F.col("l")))).first()[0] == expected


def test_lines_and_chatter(spark):
    raw = " rxDone\rRssi= -30\r\n\n  01 02 03 ,-1\r\nok\nSNR 3\nnull\nother "
    got = lines.payload_lines(spark.createDataFrame([(1, raw)], "n int, raw string")).collect()
    assert [(r["line"], r["payload_hex"]) for r in got] == [
        ("01 02 03 ,-1", "010203"), ("other", None)]


def test_unterminated_tail_is_held_back(spark):
    df = spark.createDataFrame([(b"ab\xff c\r\n\n  d\nrest",)], "raw binary")
    assert [r["line"] for r in captures.complete_lines(df).collect()] == ["ab c", "d"]


ASCII = {
    b'{"A": 1, "b": "x", "c": null, "d": [1], "e": true, "F": "2.5", "a": "y"}':
        ("json", {"e": 1.0, "f": 2.5}, {"b": "x", "a": "y"}),
    b"{bad k=1": ("kv", {"k": 1.0}, {}),
    b"a=1,B=-2.5;c=1.2.3": ("kv", {"a": 1.0, "b": -2.5}, {}),
    b"a=1 a=2": ("kv", {"a": 2.0}, {}),
    b" 1e3 ": ("scalar", {"value": 1000.0}, {}),
    b"1_000": ("scalar", {"value": 1000.0}, {}),
    b"5d": ("text", {}, {}),
    b"1, 2,,3": ("csv", {"value_0": 1.0, "value_1": 2.0, "value_2": 3.0}, {}),
    b"1,2,3,4,5,6": ("csv", {f"value_{i}": i + 1.0 for i in range(5)}, {}),
    b"1,x": ("text", {}, {}),
    b"\x00Hello\x00": ("text", {}, {}),
    b"\xff\xfe": (None, None, None),
    b"\x00 ": (None, None, None),
}


def test_ascii_branches(spark):
    df = spark.createDataFrame([(k,) for k in ASCII], "payload binary")
    for row in lines.ascii_events(df).collect():
        expected = ASCII[bytes(row["payload"])]
        assert (row["text_kind"], row["num"], row["str"]) == expected, row["payload"]


def test_python_rounding_is_exact(spark):
    import random

    rng = random.Random(5)
    values = [2.675, 0.125, 1.005, -2.675, 0.5, 1e-9, -0.0005, 430.0]
    values += [rng.randrange(-10**6, 10**6) * 0.01 * (rng.randrange(-3000, 3000) * 0.0005)
               for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", numeric.py_round(F.col("v"), 2).alias("two"),
        numeric.py_round(F.col("v"), 3).alias("three"))
    for v, two, three in df.collect():
        assert two == round(v, 2) and three == round(v, 3), v


@pytest.mark.parametrize("value", ["12", " 12 ", "+5", "-3", "1_0", "1__0", "1.5", "", "0x1", "5d",
                                   "inf", "nan", "1e5", ".5", "5.", "--1", "１２"])
def test_number_text(spark, value):
    def attempt(kind):
        try:
            return kind(value) if value.isascii() else None
        except ValueError:
            return None

    row = spark.createDataFrame([(value,)], "v string").select(
        numeric.py_int(F.col("v")), numeric.py_float(F.col("v"))).first()
    assert row[0] == attempt(int)
    expected = attempt(float)
    assert row[1] == expected or (row[1] != row[1] and expected != expected)


def test_iso_text(spark):
    df = spark.createDataFrame([(0,), (1_700_000_000,), (4_294_967_295,)], "t long")
    got = [r[0] for r in df.select(text.iso_utc(F.col("t"))).collect()]
    assert got == ["1970-01-01T00:00:00+00:00", "2023-11-14T22:13:20+00:00",
                   "2106-02-07T06:28:15+00:00"]


@pytest.mark.parametrize("most, kept", [(5, 5), (2, 2), (None, 7)])
def test_numbers_kept_of_a_list(spark, most, kept):
    from fieldstream.operators.lines import ascii_events

    df = spark.createDataFrame([(b"1,2,3,4,5,6,7",)], "payload binary")
    num = ascii_events(df, csv_values=most).first()["num"]
    assert num == {f"value_{i}": float(i + 1) for i in range(kept)}
