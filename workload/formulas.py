"""Integer formulas that turn the shipped tables into telemetry, as SQL text.

The texts are valid in both engines. ``c`` is an event's value in hundredths, ``k`` an
order key; everything else follows from them and from ids.
"""

from __future__ import annotations

EVENT_TYPE_SQL = (
    "CASE event_id % 6 WHEN 0 THEN 'SAMPLE' WHEN 1 THEN 'DELTA_UPDATE' "
    "WHEN 2 THEN 'THRESHOLD_CROSSING' WHEN 3 THEN 'ALARM' WHEN 4 THEN 'HEARTBEAT' "
    "ELSE 'DEVICE_STATUS' END")
SOURCE_SQL = (
    "CASE event_type WHEN 'view' THEN 'bmv' WHEN 'click' THEN 'mppt' "
    "WHEN 'purchase' THEN 'bms' WHEN 'signup' THEN 'rtd' ELSE 'gps' END")  # gps has no layout


def dbl(expr: str, div: int = 1) -> str:
    return f"cast({expr} as double) / {div}" if div != 1 else f"cast({expr} as double)"


def only(condition: str, expr: str) -> str:
    return f"CASE WHEN {condition} THEN {expr} END"


# Shunt-style reading of every event.
READING = {
    "current_ma": "c * 10 - 40000",
    "voltage_mv": "48000 + (c * 7) % 4000",
    "power_w": "(c % 3000) - 1500",
    "charge_state": dbl("(c * 3) % 1001", 10),
    "alarm": "CASE WHEN event_id % 41 = 0 THEN 1 + event_id % 3 ELSE 0 END",
    "tx_ok": "event_id % 11 <> 0",
}

# Columns of one typed reading per event, by source.
POWER, STATUS = "event_id % 2 = 0", "event_id % 2 = 1"
TYPED = {
    "bmv": {
        "voltage_mv": "CASE WHEN event_id % 97 = 0 THEN 70000 ELSE 48000 + (c * 7) % 4000 END",
        "current_ma": "c * 10 - 40000",
        "power_w": "(c % 3000) - 1500",
        "charge_state": only("event_id % 3 <> 0", dbl("(c * 3) % 1001", 10)),
        "alarm": "CASE WHEN event_id % 41 = 0 THEN 1 + event_id % 3 ELSE 0 END",
        "elapsed_s": "event_id * 13",
        "peak_current_ma": only("c < 4000", "c * 10 - 40000"),
    },
    "mppt": {
        "pv_voltage_v": only(POWER, dbl("c % 9000", 100)),
        "pv_current_a": only(POWER, dbl("(c * 3) % 40000 - 10000", 2000)),
        "pv_power_w": only(POWER, dbl("(c * 11) % 60000 - 30000", 100)),
        "battery_voltage_v": only(POWER, dbl("c % 6000", 100)),
        "battery_current_a": only(POWER, dbl("(c * 5) % 90000 - 20000", 2000)),
        "mode": only(STATUS, "c % 9"),
        "fault": only(STATUS, "c % 10"),
        "enabled": only(STATUS, "c % 2"),
        "ambient_temp_c": only(STATUS, "c % 200 - 100"),
        "heatsink_temp_c": only(STATUS, "c % 300 - 150"),
        "mppt_index": only("event_id % 101 <> 0", "event_id % 6"),
        "packet_id": "event_id % 2",
    },
    "bms": {
        "battery_voltage_v": dbl("5000 + c % 700", 100),
        "battery_current_a": dbl("c % 20000 - 10000", 100),
        "soc_pct": "c % 101",
        "soh_pct": "100 - c % 7",
        "cell_v_max_mv": "3300 + c % 200",
        "cell_v_min_mv": "3100 + c % 150",
        "cell_max_idx": "1 + c % 16",
        "cell_min_idx": "1 + (c * 3) % 16",
        "cell_sum_v": dbl("5000 + (c * 3) % 900", 100),
        "temp_max_c": "c % 90 - 20",
        "remaining_ah": dbl("c % 10000", 100),
        "warning_flags": only("event_id % 2 = 1", "c % 4"),
        "elapsed_s": "event_id",
    },
    "rtd": {
        "motor_temp_c": only("event_id % 29 <> 0", dbl("c % 30000 - 5000", 100)),
        "resistance_ohm": only("event_id % 29 <> 0", dbl("8000 + c % 12000", 100)),
        "fault": "CASE WHEN event_id % 29 = 0 THEN 64 ELSE 0 END",
    },
}


def typed_columns() -> dict[str, str]:
    """One expression per column over all sources, by the row's ``device_type``."""
    merged: dict[str, list[str]] = {}
    for source, columns in TYPED.items():
        for name, expr in columns.items():
            merged.setdefault(name, []).append(
                f"WHEN device_type = '{source}' THEN cast({expr} as double)")
    return {name: "CASE " + " ".join(parts) + " END" for name, parts in merged.items()}


PACKET_TS = "cast(floor(t_us / 1000000) as bigint)"
RECEIVED = "t_us + 2000000"

# Corruption of a packet: which kind, or NULL.
CORRUPT = "CASE WHEN event_id % 13 = 0 THEN event_id % 7 END"
CORRUPT_REASONS = {
    0: "crc mismatch", 1: "too short", 2: "unsupported version", 3: "unsupported msg_type",
    4: "payload too short", 5: "trailing bytes", 6: "unsupported event_type",
}

# Bus frames.
BOARD_SQL = "CASE user_id % 7 WHEN 0 THEN 17 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 " \
            "WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 9 END"
CAN_ID = f"({BOARD_SQL}) * 16 + event_id % 3"
FRAME_SIZE = "CASE WHEN event_id % 3 = 1 THEN 5 ELSE 8 END"

# Sensor codes.
RTD_CODE = "CASE WHEN event_id % 83 = 0 THEN 0 ELSE 6000 + (event_id * 37) % 6000 END"
RTD_FAULT = "CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END"
RTD_FAULT_STATUS = "CASE event_id % 3 WHEN 0 THEN 132 WHEN 1 THEN 64 ELSE 40 END"


# Battery registers of poll k.
def cell(i: str) -> str:
    return (f"CASE WHEN k % 211 = 0 THEN 0 WHEN k % 7 = 0 AND {i} = 5 THEN 0 "
            f"ELSE 3200 + (k * 13 + (112 + {i}) * 29) % 200 END")


def cell_sum() -> str:
    return "(" + " + ".join(f"({cell(str(i))})" for i in range(1, 17)) + ")"


def register(r: str) -> str:
    """Value of register ``r`` (SQL text); ``pack_cv`` must be in scope."""
    return (f"CASE WHEN {r} = 21 THEN k % 104 WHEN {r} = 22 THEN pack_cv "
            f"WHEN {r} = 24 THEN (65536 + k % 120 - 20) % 65536 WHEN {r} = 41 THEN 16 "
            f"WHEN {r} >= 113 THEN {cell(f'({r} - 112)')} "
            f"ELSE (k * 31 + {r} * 7) % 65536 END")


PACK_CV = (f"cast(floor({cell_sum()} / 10) as bigint)"
           " + CASE WHEN k % 19 = 0 THEN 150 ELSE 0 END")
REPLY_FAULT = "CASE WHEN (k + start) % 61 BETWEEN 1 AND 6 THEN (k + start) % 61 END"
REPLY_REASONS = {
    1: "crc mismatch", 2: "wrong address", 3: "exception reply", 4: "byte count",
    5: "response too short", 6: "unexpected function",
}
