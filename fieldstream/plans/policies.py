"""Send policies: which change of a reading is worth a packet."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PolicySpec:
    """Dead-band policy of one source.

    ``deltas`` maps each watched column to the change that must be reached; columns not
    named are not watched.
    """

    deltas: dict[str, float]
    heartbeat_s: float
    change_event: str = "DELTA_UPDATE"
    heartbeat_event: str = "HEARTBEAT"
    keys: tuple[str, ...] = ("device_id", "slot")

    def check(self, df: DataFrame) -> None:
        missing = [c for c in self.deltas if c not in df.columns]
        if missing:
            raise ValueError(f"watched columns not in the readings: {missing}")


@dataclass(frozen=True)
class ShuntPolicy:
    """Policy of the battery-shunt source, which ranks its events."""

    voltage_mv: int = 50
    current_ma: int = 200
    power_w: int = 10
    heartbeat_s: float = 3.0


# --- fixed values: default thresholds ----------------------------------------
BMS_POLICY = PolicySpec(
    deltas={"soc_pct": 1.0, "battery_voltage_v": 0.2, "battery_current_a": 1.0,
            "cell_v_max_mv": 10.0, "cell_v_min_mv": 10.0,
            "warning_flags": 1.0, "protection_flags": 1.0, "error_code": 1.0},
    heartbeat_s=10.0)
MPPT_POLICY = PolicySpec(
    deltas={"pv_voltage_v": 2.0, "pv_current_a": 0.5, "pv_power_w": 1.0,
            "battery_voltage_v": 1.0},
    heartbeat_s=5.0)
RTD_POLICY = PolicySpec(deltas={"motor_temp_c": 0.5, "fault": 1.0}, heartbeat_s=10.0)
BMV_POLICY = ShuntPolicy()
STATUS_SPACING_S = 5.0
WARNING_SPACING_S = 60.0
DRIVE_THRESHOLD_A = 0.5
REPORT_SECONDS = 5
POLL_GIVE_UP = 10
# --- end of fixed values ------------------------------------------------------


@dataclass(frozen=True)
class Source:
    """What a source plugs into the common path: normaliser, policy, layout, hooks."""

    normalise: object
    policy: object
    msg_type: str
    priority: int
    sinks: tuple = field(default_factory=tuple)
