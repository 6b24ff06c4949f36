"""The battery shunt's text protocol: byte lines to checked blocks to frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binary as b
from ..functions import text as t
from ..operators.fold import Fold, run_fold
from ..operators.timeline import Timeline, inherit, known_cold
from ..plans.policies import REPORT_SECONDS
from ..session import materialise

REQUIRED_KEYS = ("V", "I", "P")
BLOCK_END = "Checksum"


def parse_lines(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Byte sum, text, key and value of each line; raw bytes stay binary throughout."""
    text = t.strip(t.lenient_utf8(F.col(raw)))
    tab = F.instr(F.col("text"), "\t")
    return (
        df.withColumns({"byte_sum": b.byte_sum(F.col(raw)), "text": text})
        .withColumns({
            "key": F.when(tab > 0, F.expr("substring(text, 1, instr(text, '\t') - 1)")),
            "value": F.when(tab > 0, F.expr("substring(text, instr(text, '\t') + 1)")),
            "ends_block": F.col("text").startswith(BLOCK_END),
        })
    )


def text_blocks(df: DataFrame, keys: Sequence[str], order: str = "line_no",
                raw: str = "raw", limit: int | None = None) -> DataFrame:
    """Closed blocks of each session with their checksum verdict and key-value map.

    A block ends at a line that starts with the checksum key; every line up to there,
    garbage and blank ones too, counts in its byte sum. An unfinished block at the end of
    a capture is left out. Pairs are reduced to the last value per key before a block
    collects them, and only valid blocks do, so a run of noise never becomes one big map.
    After the shuffle by session all of it works on one shuffle by block.
    """
    parsed = parse_lines(df, raw).select(
        *keys, order, "byte_sum", "key", "value", "ends_block",
        (F.length("text") > 0).alias("_has_text"))
    line = Timeline(parsed, keys, [order], limit)
    numbered = line.scan(block_no=("before", F.col("ends_block").cast("long"))).rows
    block = [*keys, "block_no"]
    at = F.col(order)
    per_key = line.deal(numbered, block).groupBy(*block, "key").agg(
        F.max_by("value", at).alias("value"),
        F.count(F.lit(1)).alias("_lines"),
        F.count_if("_has_text").alias("_seen"),
        F.sum("byte_sum").alias("_sum"),
        F.max(F.when(F.col("ends_block"), at)).alias("_end"))
    whole = Window.partitionBy(*block)
    judged = (
        per_key.withColumns({
            "end_line": F.max("_end").over(whole),
            "byte_sum_mod": (F.sum("_sum").over(whole) % 256).cast("int")})
        .where(F.col("end_line").isNotNull())
        .withColumn("ok", F.col("byte_sum_mod") == 0)
    )
    entry = F.when(F.col("ok") & F.col("key").isNotNull(), F.struct("key", "value"))
    blocks = (
        judged.groupBy(*block, "end_line", "byte_sum_mod", "ok")
        .agg(F.sum("_lines").alias("n_lines"), F.sum("_seen").alias("n_text_lines"),
             F.map_from_entries(F.collect_list(entry)).alias("fields"))
        .withColumn("fields", F.when(F.col("ok"), F.col("fields")))
    )
    return inherit(blocks, numbered)


class _Accumulate(Fold):
    """State: (required keys present so far, block the frame began with or None).

    Complete means emit and start afresh. Whatever a slice starts with, its outcome depends
    only on which of the few required keys were present, so the summary lists the end for
    each of those; a begin that is still the entry's own is marked.
    """

    inputs = ("block_no", "_present")
    output = "returned boolean, frame_block bigint"
    own = -1

    def __init__(self, n_required: int):
        self.full = (1 << n_required) - 1

    def initial(self):
        return 0, None

    def step(self, state, row):
        present, begin = state[0] | row[1], row[0] if state[1] is None else state[1]
        done = present == self.full
        return ((0, None) if done else (present, begin)), (done, begin)

    def summarise(self, rows):
        ends = []
        for state in [(0, None), *[(present, self.own) for present in range(self.full)]]:
            for row in rows:
                state, _ = self.step(state, row)
            ends.append(state)
        return ends

    def chain(self, state, summary):
        present, begin = state
        if begin is None:
            return tuple(summary[0])
        after, began = summary[1 + present]
        return after, (begin if began == self.own else began)


def accumulate(blocks: DataFrame, keys: Sequence[str],
               required: Sequence[str] = REQUIRED_KEYS,
               limit: int | None = None) -> DataFrame:
    """Valid blocks with ``frame_block``, the first block of the frame each one goes into,
    and whether it completes that frame.

    Only the presence bits of the required keys take part in the sequential step.
    """
    present = sum((F.when(F.map_contains_key("fields", F.lit(k)), 1 << i).otherwise(0)
                   for i, k in enumerate(required)), F.lit(0))
    valid = inherit(
        blocks.where("ok").select(*keys, "block_no", "fields", present.alias("_present")), blocks)
    if not known_cold(valid, keys):  # they are counted, dealt and folded: worked out once
        valid = materialise(valid, "blocks")
    return run_fold(
        Timeline(valid, keys, ["block_no"], limit), _Accumulate(len(required)), ["fields"])


def text_frames(blocks: DataFrame, keys: Sequence[str],
                required: Sequence[str] = REQUIRED_KEYS,
                limit: int | None = None) -> DataFrame:
    """Frames: consecutive valid blocks merged until all required keys are present.

    Within a frame a later block's value wins. Blocks after the last complete frame wait
    for more and are left out. Values are reduced to one per key before a frame collects
    them, however many blocks it spans.
    """
    frame = [*keys, "frame_block"]
    latest = (
        accumulate(blocks, keys, required, limit)
        .select(*frame, "block_no", "returned", F.explode("fields").alias("key", "value"))
        .groupBy(*frame, "key").agg(
            F.max_by("value", "block_no").alias("value"),
            F.max(F.when(F.col("returned"), F.col("block_no"))).alias("_end"))
    )
    return (
        latest.groupBy(*frame).agg(
            F.max("_end").alias("end_block"),
            F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
        .where(F.col("end_block").isNotNull())
    )


def missing_block_runs(blocks: DataFrame, keys: Sequence[str],
                       required: Sequence[str] = REQUIRED_KEYS,
                       limit: int | None = None) -> DataFrame:
    """Runs of two or more valid blocks that did not complete a frame.

    One block between frames is the normal cadence. Each run reports its first and last
    block, its length, the required keys still missing and all keys held, sorted.
    """
    run = [*keys, "frame_block"]
    held = (
        accumulate(blocks, keys, required, limit).where(~F.col("returned"))
        .select(*run, "block_no", F.posexplode_outer(F.map_keys("fields")).alias("_pos", "key"))
        .groupBy(*run, "key").agg(
            F.min("block_no").alias("_first"), F.max("block_no").alias("_last"),
            F.count_if(F.coalesce("_pos", F.lit(0)) == 0).alias("_blocks"))
    )
    runs = held.groupBy(*run).agg(
        F.min("_first").alias("first_block"), F.max("_last").alias("last_block"),
        F.sum("_blocks").alias("n_blocks"),
        F.array_sort(F.collect_list("key")).alias("have_keys"))
    needed = F.array(*[F.lit(k) for k in required])
    return (
        runs.where(F.col("n_blocks") >= 2)
        .withColumn("missing_keys", F.array_except(needed, F.col("have_keys")))
        .drop("frame_block")
    )


def text_health(df: DataFrame, keys: Sequence[str], time_us: str = "rx_us",
                order: str = "line_no", raw: str = "raw",
                seconds: int = REPORT_SECONDS, limit: int | None = None) -> DataFrame:
    """Lines, finished blocks and checksum failures per interval.

    Intervals are fixed tumbling windows; the device-side counters instead start a new
    interval at the first event after the last report.
    """
    slot = F.floor(F.col(time_us) / F.lit(seconds * 1_000_000)) * seconds
    parsed = parse_lines(df, raw).select(
        *keys, order, "byte_sum", "ends_block", slot.alias("window_s"),
        (F.length("text") > 0).alias("_has_text"))
    line = Timeline(parsed, keys, [order], limit)
    numbered = line.scan(block_no=("before", F.col("ends_block").cast("long"))).rows
    block = [*keys, "block_no"]
    ended = (
        line.deal(numbered, block).groupBy(*block, "window_s").agg(
            F.count_if("_has_text").alias("lines"),
            F.max("ends_block").alias("_ended"), F.sum("byte_sum").alias("_sum"))
        .withColumn("_sum", F.sum("_sum").over(Window.partitionBy(*block)))
    )
    # A block counts in the interval of its last line.
    return ended.groupBy(*keys, "window_s").agg(
        F.sum("lines").alias("lines"), F.count_if("_ended").alias("blocks"),
        F.count_if(F.col("_ended") & (F.col("_sum") % 256 != 0)).alias("checksum_failures")
    ).where("lines > 0")
