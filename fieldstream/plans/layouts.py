"""Wire layouts and the schemas that follow from them."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql.types import DoubleType, StructField, StructType

# --- fixed values -----------------------------------------------------------
PROTOCOL_VERSION = 3
HEADER_BYTES = 12          # version, type, event, device: 1 byte each; seq 2; time 4; mask 2
CRC_BYTES = 2
BATCH_MAGIC = 0xB5
BATCH_MAX_BYTES = 180
BATCH_MAX_PACKETS = 255
FRAME_PACKET_LIMIT = 4     # packets of the bus stream that may share one frame

MSG_TYPES = {1: "BMV", 2: "MPPT", 3: "BMS", 4: "RTD"}
EVENT_TYPES = {
    1: "SAMPLE",
    2: "DELTA_UPDATE",
    3: "THRESHOLD_CROSSING",
    4: "ALARM",
    5: "HEARTBEAT",
    6: "DEVICE_STATUS",
}

# Every wire field: type, bit, name, integer format, scale, display divisor.
# Formats: b/B 1 byte, h/H 2 bytes, i/I 4 bytes; lower case is signed; big endian.
FIELD_ROWS = (
    ("BMV", 0, "voltage_mv", "H", 1, 1000),
    ("BMV", 1, "current_ma", "i", 1, 1000),
    ("BMV", 2, "power_w", "h", 1, 1),
    ("BMV", 3, "charge_state", "B", 1, 1),
    ("BMV", 4, "alarm", "B", 1, 1),
    ("BMV", 5, "elapsed_s", "I", 1, 1),
    ("BMV", 6, "peak_current_ma", "i", 1, 1000),
    ("MPPT", 0, "pv_voltage_v", "H", 100, 1),
    ("MPPT", 1, "pv_current_a", "h", 2000, 1),
    ("MPPT", 2, "pv_power_w", "h", 100, 1),
    ("MPPT", 3, "battery_voltage_v", "H", 100, 1),
    ("MPPT", 4, "battery_current_a", "h", 2000, 1),
    ("MPPT", 5, "mode", "B", 1, 1),
    ("MPPT", 6, "fault", "B", 1, 1),
    ("MPPT", 7, "enabled", "B", 1, 1),
    ("MPPT", 8, "ambient_temp_c", "b", 1, 1),
    ("MPPT", 9, "heatsink_temp_c", "b", 1, 1),
    ("MPPT", 10, "mppt_index", "B", 1, 1),
    ("MPPT", 11, "packet_id", "B", 1, 1),
    ("MPPT", 12, "elapsed_s", "I", 1, 1),
    ("BMS", 0, "battery_voltage_v", "H", 100, 1),
    ("BMS", 1, "battery_current_a", "h", 100, 1),
    ("BMS", 2, "soc_pct", "B", 1, 1),
    ("BMS", 3, "soh_pct", "B", 1, 1),
    ("BMS", 4, "cell_v_max_mv", "H", 1, 1),
    ("BMS", 5, "cell_v_min_mv", "H", 1, 1),
    ("BMS", 6, "cell_max_idx", "B", 1, 1),
    ("BMS", 7, "cell_min_idx", "B", 1, 1),
    ("BMS", 8, "cell_sum_v", "H", 100, 1),
    ("BMS", 9, "temp_max_c", "b", 1, 1),
    ("BMS", 10, "temp_avg_c", "b", 1, 1),
    ("BMS", 11, "remaining_ah", "H", 10, 1),
    ("BMS", 12, "warning_flags", "H", 1, 1),
    ("BMS", 13, "protection_flags", "H", 1, 1),
    ("BMS", 14, "error_code", "H", 1, 1),
    ("BMS", 15, "elapsed_s", "I", 1, 1),
    ("RTD", 0, "motor_temp_c", "h", 100, 1),
    ("RTD", 1, "resistance_ohm", "H", 100, 1),
    ("RTD", 2, "fault", "B", 1, 1),
)
# --- end of fixed values ----------------------------------------------------

SIZES = {"b": 1, "h": 2, "i": 4}


@dataclass(frozen=True)
class Field:
    msg_type: str
    ord: int
    name: str
    fmt: str
    scale: int
    display_div: int

    @property
    def bit(self) -> int:
        return 1 << self.ord

    @property
    def size(self) -> int:
        return SIZES[self.fmt.lower()]

    @property
    def signed(self) -> bool:
        return self.fmt.islower()

    @property
    def low(self) -> int:
        return -(1 << (8 * self.size - 1)) if self.signed else 0

    @property
    def high(self) -> int:
        return (1 << (8 * self.size - (1 if self.signed else 0))) - 1

    @property
    def divisor(self) -> int:
        return self.scale * self.display_div


LAYOUTS: dict[str, tuple[Field, ...]] = {
    t: tuple(Field(*row) for row in FIELD_ROWS if row[0] == t) for t in MSG_TYPES.values()}
TYPE_IDS = {name: number for number, name in MSG_TYPES.items()}
EVENT_IDS = {name: number for number, name in EVENT_TYPES.items()}

# Columns computed after decoding: type -> (new column, source column, builder).
DERIVED = {
    "RTD": (("motor_temp_f", "motor_temp_c", "c_to_f_rounded"),),
}


#: What a decoded packet of each type carries: its wire fields, then the derived columns.
SCHEMAS: dict[str, StructType] = {
    t: StructType([StructField(name, DoubleType()) for name in
                   [f.name for f in fields] + [d[0] for d in DERIVED.get(t, ())]])
    for t, fields in LAYOUTS.items()}


def decoded_columns(msg_type: str) -> tuple[str, ...]:
    return tuple(SCHEMAS[msg_type].names)


def all_decoded_columns() -> tuple[str, ...]:
    """Every column any type can carry, in the order first met."""
    return tuple(dict.fromkeys(chain.from_iterable(s.names for s in SCHEMAS.values())))


EVENT_META_COLUMNS = (
    "received_at", "packet_timestamp", "msg_type", "event_type", "device_id", "seq",
)


def event_csv_columns() -> tuple[str, ...]:
    return EVENT_META_COLUMNS + all_decoded_columns()
