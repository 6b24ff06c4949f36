"""Which readings are sent: dead-band, ranked shunt events, heartbeats and spacing rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.policies import STATUS_SPACING_S, WARNING_SPACING_S, PolicySpec, ShuntPolicy
from .emission import run_policy
from .timeline import Timeline
from .triggers import Changed, Due, Moved, Policy, Raised, Whole

MICROS = 1_000_000


def deadband_policy(spec: PolicySpec, time: str, ok: str | None = None) -> Policy:
    """A row that differs enough from the last one sent, or a heartbeat.

    A change is: the first row, a watched value appearing or disappearing, one moving to or
    from zero, or one moving by at least its delta. Values that are not numbers change when
    they differ. Otherwise the heartbeat applies.
    """
    return Policy(
        spec.change_event,
        [Changed(c, delta, spec.change_event) for c, delta in spec.deltas.items()],
        Due(time, int(spec.heartbeat_s * MICROS), spec.heartbeat_event), ok)


def shunt_policy(policy: ShuntPolicy, time: str, ok: str | None = None) -> Policy:
    """SAMPLE, then ALARM, THRESHOLD_CROSSING, DELTA_UPDATE, HEARTBEAT in that order.

    An alarm counts only when it changes to non-zero; the charge is compared as whole
    percents, because that is what the wire carries; a missing voltage, current or power
    counts as zero.
    """
    return Policy("SAMPLE", [
        Raised("alarm", "ALARM"),
        Whole("charge_state", "THRESHOLD_CROSSING"),
        Moved("voltage_mv", policy.voltage_mv, "DELTA_UPDATE"),
        Moved("current_ma", policy.current_ma, "DELTA_UPDATE"),
        Moved("power_w", policy.power_w, "DELTA_UPDATE"),
    ], Due(time, int(policy.heartbeat_s * MICROS), "HEARTBEAT"), ok)


def spacing_policy(seconds: float, time: str) -> Policy:
    """A row once the spacing has passed since the last one."""
    return Policy("FIRST", [], Due(time, int(seconds * MICROS), "SPACED"))


def spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: float,
           keep: Sequence[str], limit: int | None) -> DataFrame:
    timeline = Timeline(df, keys, order, limit)
    return run_policy(timeline, spacing_policy(seconds, order[0]), keep).drop("event_type")


def deadband(df: DataFrame, spec: PolicySpec, keys: Sequence[str],
             order: Sequence[str] = ("t_us",), ok: str | None = None,
             keep: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows to send under a dead-band policy, with their ``event_type``.

    With ``ok`` naming a boolean column, every attempt is returned but only a successful
    one becomes the state, so a failed send is tried again with the next row.
    """
    spec.check(df)
    kept = [*keep, *([ok] if ok else [])]
    return run_policy(Timeline(df, keys, order, limit), deadband_policy(spec, order[0], ok), kept)


def heartbeat(df: DataFrame, seconds: float, keys: Sequence[str],
              order: Sequence[str] = ("t_us",), keep: Sequence[str] = (),
              limit: int | None = None) -> DataFrame:
    """Rows a quiet source still sends: the first, then one per heartbeat interval."""
    spec = PolicySpec(deltas={}, heartbeat_s=seconds, change_event="SAMPLE")
    return deadband(df, spec, keys, order, keep=keep, limit=limit)


def classify_shunt(df: DataFrame, policy: ShuntPolicy, keys: Sequence[str],
                   order: Sequence[str] = ("t_us",), ok: str | None = None,
                   keep: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Rows to send of the battery shunt, with their ranked ``event_type``."""
    kept = [*keep, *([ok] if ok else [])]
    return run_policy(Timeline(df, keys, order, limit), shunt_policy(policy, order[0], ok), kept)


def status_throttle(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_us",),
                    seconds: float = STATUS_SPACING_S, keep: Sequence[str] = (),
                    limit: int | None = None) -> DataFrame:
    """Status rows that may be attempted: at most one per slot and spacing."""
    return spaced(df, keys, order, seconds, keep, limit)


def rate_limited_warnings(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_us",),
                          seconds: float = WARNING_SPACING_S, keep: Sequence[str] = (),
                          limit: int | None = None) -> DataFrame:
    """Violations that are reported: at most one per spacing, shared by all rules."""
    return spaced(df, keys, order, seconds, keep, limit)
