import struct

import pytest
from pyspark.sql import functions as F

from fieldstream.functions import binary as b
from fieldstream.operators import batches, packets
from fieldstream.plans.layouts import LAYOUTS, TYPE_IDS


def reading(device_type, **values):
    return {"device_type": device_type, "device_id": 300, "event_type": "DELTA_UPDATE",
            "seq": 65_537, "packet_ts": 1_700_000_000, **values}


def encode(spark, device_type, schema, **values):
    row = reading(device_type, **values)
    base = "device_type string, device_id int, event_type string, seq int, packet_ts long"
    df = spark.createDataFrame([tuple(row.values())], f"{base}, {schema}")
    return packets.encode_packets(df)


def bitwise_crc(data):
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def test_check_values(spark):
    row = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "v binary").select(
        b.crc16_ccitt("v").alias("ccitt"), b.crc16_modbus("v").alias("modbus"),
        b.byte_sum("v").alias("total")).collect()
    assert tuple(row[0]) == (0x29B1, 0x4B37, sum(b"123456789"))
    assert tuple(row[1]) == (0xFFFF, 0xFFFF, 0)
    assert tuple(row[2]) == (None, None, None)


def test_known_bytes(spark):
    got = encode(spark, "bmv", "voltage_mv int, current_ma int, alarm int",
                 voltage_mv=52_100, current_ma=-40_000, alarm=0).first()
    body = struct.pack(">BBBBHIH", 3, 1, 2, 300 & 0xFF, 1, 1_700_000_000, 0b10011)
    body += struct.pack(">HiB", 52_100, -40_000, 0)
    assert bytes(got["packet"]) == body + struct.pack(">H", bitwise_crc(body))
    assert got["clamped"] == []


def test_clamp_and_half_even(spark):
    got = encode(spark, "mppt", "battery_current_a double, pv_voltage_v double, mppt_index int, "
                 "heatsink_temp_c double, mode_name string", battery_current_a=20.0,
                 pv_voltage_v=0.125, mppt_index=2, heatsink_temp_c=-200.0, mode_name="Fault")
    assert got.first()["clamped"] == ["battery_current_a", "heatsink_temp_c"]
    back = packets.decode_packets(got).first()
    assert back["battery_current_a"] == 16.3835
    assert back["pv_voltage_v"] == 0.12
    assert back["heatsink_temp_c"] == -128.0
    assert back["mode"] is None


def test_encode_guards(spark):
    assert encode(spark, "mppt", "mppt_index int", mppt_index=None).first()[
        "encode_error"] == "missing mppt_index"
    assert encode(spark, "gps", "fault int", fault=1).first()["encode_error"] == "wrong device_type"


@pytest.mark.parametrize("msg_type", list(LAYOUTS))
def test_round_trip_of_every_mask(spark, msg_type):
    """Each field alone, all together, and none."""
    fields = LAYOUTS[msg_type]
    masks = [0, (1 << len(fields)) - 1, *[f.bit for f in fields]]
    rows = []
    for n, mask in enumerate(masks):
        values = [(f.low + (f.high - f.low) * (n + 1) // (len(masks) + 2)) / f.scale
                  if mask & f.bit else None for f in fields]
        rows.append((n, msg_type.lower(), 7, "SAMPLE", n, n, *values))
    schema = ("n int, device_type string, device_id int, event_type string, seq int, "
              "packet_ts long, " + ", ".join(f"{f.name} double" for f in fields))
    df = spark.createDataFrame(rows, schema)
    if msg_type == "MPPT":
        df = df.withColumn("mppt_index", F.coalesce("mppt_index", F.lit(0.0)))
    wanted = {r["n"]: r for r in df.collect()}
    for got in packets.decode_packets(packets.encode_packets(df)).collect():
        assert got["reject_reason"] is None and got["msg_type"] == msg_type
        for f in fields:
            value = wanted[got["seq"]][f.name]
            if value is None:
                assert got[f.name] is None
            else:
                assert abs(got[f.name] * f.display_div - value) <= 0.5 / f.scale


def test_reject_reasons(spark):
    def packet(version=3, kind=4, event=1, mask=0b100, payload=b"\x01", crc=0):
        body = struct.pack(">BBBBHIH", version, kind, event, 1, 2, 3, mask) + payload
        return body + struct.pack(">H", bitwise_crc(body) ^ crc)

    cases = {
        b"": "too short", b"\x00" * 13: "too short", packet(crc=1): "crc mismatch",
        packet(version=2): "unsupported version", packet(kind=9): "unsupported msg_type",
        packet(payload=b""): "payload too short", packet(payload=b"\x01\x02"): "trailing bytes",
        packet(event=7): "unsupported event_type", packet(): None,
        packet(mask=0b100 | 0x8000): None,
        packet(version=2, kind=9): "unsupported version",
        packet(kind=9, event=99): "unsupported msg_type",
    }
    df = spark.createDataFrame(list(cases.items()), "packet binary, expected string")
    for row in packets.decode_packets(df).collect():
        assert row["reject_reason"] == row["expected"]
    assert packets.decoded_only(packets.decode_packets(df)).count() == 2
    side = packets.rejects(packets.decode_packets(df), "decode", "packet")
    assert side.count() == 10 and side.columns == ["stage", "reason", "raw"]


def test_derived_columns_are_pluggable(spark):
    df = encode(spark, "rtd", "motor_temp_c double, fault int", motor_temp_c=21.37, fault=0)
    decoded = packets.decode_packets(df)
    assert decoded.first()["motor_temp_f"] == round(21.37 * 9 / 5 + 32, 2)
    more = packets.add_derived(decoded, {"RTD": (("kelvin", "motor_temp_c", "k"),)},
                               {"k": lambda c: c + 273.15})
    assert more.first()["kelvin"] == 21.37 + 273.15


def test_batches_keep_the_limits(spark):
    rows = [(1, n, bytes([n] * 40)) for n in range(4)]            # 2 + 4 * 41 = 166 bytes
    rows += [(2, n, bytes([n] * 50)) for n in range(4)]           # 206 bytes
    rows += [(3, n, b"x") for n in range(300)]                    # too many
    rows += [(4, 0, b"")] + [(5, 0, b"only")]
    df = spark.createDataFrame(rows, "g int, n int, packet binary")
    got = {r["g"]: r for r in batches.build_batches(df, ["g"], ["n"]).collect()}
    assert got[2]["build_error"] == "frame too long"
    assert got[3]["build_error"] == "too many packets"
    assert got[4]["build_error"] == "element size out of range"
    assert got[2]["frame"] is None and len(got[1]["frame"]) == 166
    parts = batches.split_batches(
        batches.build_batches(df.where("g = 1"), ["g"], ["n"])).orderBy("element_pos").collect()
    assert [bytes(p["packet"]) for p in parts] == [bytes([n] * 40) for n in range(4)]
    bare = batches.build_batches(df.where("g = 5"), ["g"], ["n"], bare_single=True).first()
    assert bytes(bare["frame"]) == b"only"
    assert TYPE_IDS["RTD"] == 4


def test_bad_containers(spark):
    cases = {
        b"\xb5\x01\x02ab": None, b"\xb5\x00": None,
        b"\xb5\x02\x02ab": "truncated: missing length byte",
        b"\xb5\x01\x03ab": "truncated: element shorter than declared",
        b"\xb5\x01\x02abc": "trailing bytes", b"\x03\x01": "not a batch frame",
    }
    df = spark.createDataFrame(list(cases.items()), "frame binary, expected string")
    for row in batches.split_batches(df).collect():
        assert row["reject_reason"] == row["expected"]
