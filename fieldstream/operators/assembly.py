"""Whose packet goes next, and which due packets share a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layouts import BATCH_MAX_BYTES, FRAME_PACKET_LIMIT
from .fold import FiniteState, run_fold
from .timeline import Timeline


def priority_rank(df: DataFrame, keys: Sequence[str], arrival: str = "arrival",
                  limit: int | None = None) -> DataFrame:
    """Rank pending sends: lowest priority number first, then arrival.

    The rank within one priority is a time line, so a crowded tick is cut along its
    arrivals; the sends of more urgent priorities are counted and added.
    """
    group = [*keys, "priority"]
    within = Timeline(df, group, [arrival], limit).scan(_nth=("count", F.lit(1))).rows
    earlier = (Window.partitionBy(*keys).orderBy("priority")
               .rowsBetween(Window.unboundedPreceding, -1))
    ahead = (
        df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        .select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    )
    return (
        within.join(ahead, group, "inner")
        .withColumn("send_rank", F.col("_nth") + F.col("_ahead")).drop("_nth", "_ahead")
    )


def next_to_send(df: DataFrame, keys: Sequence[str], arrival: str = "arrival",
                 values: Sequence[str] = ()) -> DataFrame:
    """The one pending send that is served next (pre-aggregated before the shuffle)."""
    first = df.groupBy(*keys).agg(F.min(F.struct("priority", arrival, *values)).alias("_f"))
    return first.select(*keys, "_f.*")


class _Relay(FiniteState):
    """A tick starts where the tick before left off; ``_leads`` says where each start leads."""

    inputs = ("_leads",)
    output = "_start int"

    def __init__(self, slots: int):
        self.states = list(range(max(slots, 1)))

    def step(self, state, row):
        # A summary also asks for starts beyond a ring that is still short; none is reached.
        start = state % len(row[0])
        return row[0][start], (start,)


def _totals(values: Column) -> Column:
    """Sums of the first 0, 1, ... entries of a ring that is walked twice."""
    twice = F.concat(values, values)
    return F.transform(F.sequence(F.lit(0), F.size(twice)), lambda i: F.aggregate(
        F.slice(twice, F.lit(1), i), F.lit(0), lambda total, x: total + x))


class _Ring:
    """Which entries of a ring a frame takes when it starts at a given one.

    An entry is looked at while the due ones before it are fewer than ``packets`` and fit
    the frame; it is taken if it is due and still fits.
    """

    def __init__(self, packets: int, frame_bytes: int):
        self.packets, self.room = packets, frame_bytes - 2
        self.due, self.used = F.col("_due"), F.col("_used")
        self.steps = F.sequence(F.lit(0), F.size("_sizes") - 1)

    @staticmethod
    def totals() -> dict[str, Column]:
        return {
            "_due": _totals(F.transform("_sizes", lambda n: (n > 0).cast("int"))),
            "_used": _totals(F.transform("_sizes", lambda n: F.when(n > 0, n + 1).otherwise(0)))}

    def _open(self, start: Column, i: Column) -> Column:
        return ((F.get(self.due, start + i) - F.get(self.due, start) < self.packets)
                & (F.get(self.used, start + i) - F.get(self.used, start) <= self.room))

    def leads(self) -> Column:
        def after(start):
            return F.size(F.filter(self.steps, lambda i: self._open(start, i)))

        return F.transform(self.steps, lambda a: (a + after(a)) % F.size("_sizes"))

    def taken(self, start: Column) -> Column:
        """Positions in the ring, in the order taken."""
        found = F.filter(self.steps, lambda i: self._open(start, i) & (
            F.get(self.due, start + i + 1) > F.get(self.due, start + i)) & (
            F.get(self.used, start + i + 1) - F.get(self.used, start) <= self.room))
        return F.transform(found, lambda i: (start + i) % F.size("_sizes"))


def slot_rejects(due: DataFrame, slot: str = "slot", slots: int = 12) -> DataFrame:
    """Rows whose slot number is outside the slot dimension, with a reason; none is packed."""
    bad = F.col(slot).isNull() | (F.col(slot) < 0) | (F.col(slot) >= slots)
    return due.where(bad).withColumn("reject_reason", F.lit("slot number out of range"))


def pick_batches(due: DataFrame, session: Sequence[str], tick: str = "tick",
                 slot: str = "slot", size: str = "packet_bytes", slots: int = 12,
                 packets: int = FRAME_PACKET_LIMIT, frame_bytes: int = BATCH_MAX_BYTES,
                 limit: int | None = None) -> DataFrame:
    """Which due packets ride in each tick's frame, in order of ``frame_pos``.

    ``due`` has rows of a tick and a slot (0 to ``slots`` - 1; others are in
    ``slot_rejects``); a size of 0 or NULL means nothing is due. Every tick goes round all
    slots that its session has seen so far, in order of first tick, then number.
    """
    per_slot = (due.where((F.col(slot) >= 0) & (F.col(slot) < slots))
                .groupBy(*session, tick, slot)
                .agg(F.coalesce(F.max(size), F.lit(0)).cast("int").alias("_size")))
    ticks = per_slot.groupBy(*session, tick).agg(F.map_from_entries(F.collect_list(
        F.struct(slot, "_size"))).alias("_sent"))
    seen = per_slot.groupBy(*session, slot).agg(F.min(tick).alias("_since"))
    rings = seen.groupBy(*session).agg(F.sort_array(F.collect_list(
        F.struct("_since", F.col(slot).alias("slot")))).alias("_ring"))
    known = F.filter("_ring", lambda x: x["_since"] <= F.col(tick))
    ring = _Ring(packets, frame_bytes)
    laid = (
        ticks.join(rings, list(session))
        .withColumn("_slots", F.transform(known, lambda x: x["slot"]))
        .withColumn("_sizes", F.transform("_slots", lambda x: F.coalesce(
            F.try_element_at("_sent", x), F.lit(0))))
        .withColumns(ring.totals()).withColumn("_leads", ring.leads())
        .select(*session, tick, "_slots", "_sizes", "_leads"))
    started = run_fold(Timeline(laid, session, [tick], limit), _Relay(slots),
                       ["_slots", "_sizes"])
    return (
        started.withColumns(ring.totals())
        .select(*session, tick, "_slots", "_sizes",
                F.posexplode(ring.taken(F.col("_start"))).alias("frame_pos", "_at"))
        .select(*session, tick, "frame_pos", F.get("_slots", F.col("_at")).alias(slot),
                F.get("_sizes", F.col("_at")).alias(size))
    )
