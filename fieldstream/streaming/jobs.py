"""Streams that use the same definitions as the batch operators.

Micro-batches are bounded with ``maxFilesPerTrigger`` (or the source's own limit), which
takes the place of a queue that drops what it cannot hold.

Ordered streams keep a reorder buffer per key: a row waits in the state until the watermark
has passed it, and is then worked on in order, so files that come out of order within the
delay give the batch answer. What is later than the watermark is dropped by Spark (and
counted by it as ``numRowsDroppedByWatermark``): the delay says how long a row may be under
way. The last rows of a stream are released once something newer moves the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import WHITE_SPACE
from ..operators.emission import pack, unpack
from ..operators.lines import decode_lines, payload_lines
from ..operators.loss import PLAUSIBLE_GAP, SEQUENCE_SPAN
from ..operators.send_policy import deadband_policy
from ..operators.triggers import sent
from ..plans.policies import PolicySpec

AT = "_at"
#: Arrow to pandas without turning whole numbers that may be null into floats.
NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(),
            pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(),
            pa.float64(): pd.Float64Dtype(), pa.string(): pd.StringDtype()}

#: (carried row or None, ready rows in order, watermark in us) -> (columns, row to carry)
Advance = Callable[[pa.RecordBatch | None, pa.RecordBatch, int],
                   tuple[dict[str, pa.Array], pa.RecordBatch | None]]


def decode_stream(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Raw modem lines to events and rejects: stateless, so the batch code applies."""
    return decode_lines(payload_lines(lines, raw))


def _arrow(frames: list[pd.DataFrame], schema: pa.Schema) -> pa.Table:
    """Rows of a micro-batch; pandas' floats with NaN become whole numbers with null again."""
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(
        [pa.array(f[x.name], type=x.type, from_pandas=True) for x in schema], schema=schema)
        for f in frames], schema)


def ordered_stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Sequence[str], delay_s: float, output: str, advance: Advance,
                   timer_us: Callable[[pa.RecordBatch], int] | None = None) -> DataFrame:
    """Run ``advance`` over every key's rows in order; ``order[0]`` is event time in us.

    ``output`` is the DDL of the columns that ``advance`` makes; the keys are put before
    them. With ``timer_us`` a key is also advanced, without new rows, when the watermark has
    passed that time of its carried row. A key's buffer holds the rows of one delay.
    """
    held = [*order, *values]
    slim = rows.select(*keys, *held).withColumn(AT, F.timestamp_micros(order[0])).withWatermark(
        AT, f"{int(delay_s * 1000)} milliseconds")
    arrow = to_arrow_schema(rows.select(*held).schema)
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(", ".join([*(f"`{k}` {kinds[k]}" for k in keys), output]))
    out_schema = to_arrow_schema(schema)

    def observe(key, batches: Iterator[pd.DataFrame], state: GroupState):
        buffer, carry = (None, None)
        if state.exists:
            buffer, carry = (None if x is None else unpack(x) for x in state.get)
        fresh = _arrow([] if state.hasTimedOut else list(batches), arrow)
        table = fresh if buffer is None else pa.concat_tables(
            [pa.Table.from_batches([buffer]), fresh])
        table = table.sort_by([(c, "ascending") for c in order]).combine_chunks()
        mark = state.getCurrentWatermarkMs() * 1000
        ready = int(np.searchsorted(table[order[0]].to_numpy(), mark, "right"))
        first = table.slice(0, ready).combine_chunks().to_batches() or [
            pa.RecordBatch.from_pylist([], schema=arrow)]
        columns, carry = advance(carry, first[0], mark)
        rest = table.slice(ready).combine_chunks().to_batches()
        waits = rest[0] if rest and len(rest[0]) else None
        state.update((None if waits is None else pack(waits),
                      None if carry is None else pack(carry)))
        due = [] if waits is None else [waits.column(order[0])[0].as_py()]
        if timer_us is not None and carry is not None:
            due.append(timer_us(carry))
        if due:
            state.setTimeoutTimestamp(max(-(-min(due) // 1000), mark // 1000 + 1))
        n = len(next(iter(columns.values())))
        made = [pa.array([k] * n, f.type) for k, f in zip(key, out_schema)]
        made += [columns[f.name].cast(f.type) for f in list(out_schema)[len(key):]]
        yield pa.Table.from_arrays(made, schema=out_schema).to_pandas(
            types_mapper=NULLABLE.get)

    return slim.groupBy(*keys).applyInPandasWithState(
        observe, schema, "buffer binary, carry binary", "append",
        GroupStateTimeout.EventTimeTimeout)


def line_stream(chunks: DataFrame, keys: Sequence[str], order: Sequence[str],
                raw: str = "raw", delay_s: float = 60.0) -> DataFrame:
    """``reassembled_lines`` over a stream: the tail behind the last line feed, and the
    number of lines so far, are the state of a capture."""
    def advance(carry, rows, mark):
        tail, number = (b"", 0) if carry is None else (
            carry.column("tail")[0].as_py(), carry.column("number")[0].as_py())
        *whole, tail = b"".join(
            [tail, *(x or b"" for x in rows.column(raw).to_pylist())]).split(b"\n")
        lines = [x.decode(errors="ignore").strip(WHITE_SPACE) for x in whole]
        kept = [i for i, x in enumerate(lines) if x]
        columns = {"line_no": pa.array([number + i for i in kept], pa.int64()),
                   "line": pa.array([lines[i] for i in kept], pa.string())}
        return columns, pa.RecordBatch.from_pylist(
            [{"tail": tail, "number": number + len(whole)}])

    return ordered_stream(chunks, keys, order, [raw], delay_s, "line_no bigint, line string",
                          advance)


def gap_stream(packets: DataFrame, session: Sequence[str], order: Sequence[str] = ("arrival",),
               delay_s: float = 60.0, values: Sequence[str] = ()) -> DataFrame:
    """``sequence_gaps`` over a stream: the last packet of each type is carried."""
    kinds = dict(packets.dtypes)
    shown = [*order, *values]
    output = ", ".join([*(f"`{c}` {kinds[c]}" for c in shown),
                        "seq int, prev_seq int, gap int, lost int"])

    def advance(carry, rows, mark):
        seq = rows.column("seq").to_numpy(zero_copy_only=False).astype(np.int64)
        first = -1 if carry is None else carry.column("seq")[0].as_py()
        prev = np.append(first, seq)[:-1] if len(seq) else seq
        gap = (seq - prev - 1) % SEQUENCE_SPAN
        none = prev < 0
        lost = np.where(~none & (gap > 0) & (gap < PLAUSIBLE_GAP), gap, 0)
        columns = {c: rows.column(c) for c in shown}
        columns |= {"seq": rows.column("seq"), "prev_seq": pa.array(prev, mask=none),
                    "gap": pa.array(gap, mask=none), "lost": pa.array(lost)}
        return columns, rows.slice(len(rows) - 1, 1) if len(rows) else carry

    return ordered_stream(packets, [*session, "msg_type"], order, [*values, "seq"], delay_s,
                          output, advance)


def deadband_stream(readings: DataFrame, spec: PolicySpec, keys: Sequence[str],
                    order: Sequence[str] = ("t_us",), delay_s: float = 60.0) -> DataFrame:
    """``deadband`` over a stream: the batch policy, with the last sent row carried."""
    spec.check(readings)
    policy = deadband_policy(spec, order[0])
    kinds = dict(readings.dtypes)
    output = ", ".join([*(f"`{c}` {kinds[c]}" for c in order),
                        "event_type string, prev_t_us bigint"])

    def advance(carry, rows, mark):
        shift = 0 if carry is None else 1
        both = [rows] if carry is None else [carry, rows]
        work = pa.Table.from_batches(both).combine_chunks().to_batches()
        work = work[0] if work else rows
        if not len(work):
            empty = rows.slice(0, 0)
            return {**{c: empty.column(c) for c in order},
                    "event_type": pa.array([], pa.string()),
                    "prev_t_us": pa.array([], pa.int64())}, carry
        seed = np.zeros(len(work), bool)
        seed[:shift] = True
        at, rank, then, last = sent(policy, work, np.zeros(1, np.int64), seed)
        names = np.array([*policy.events, policy.first], dtype=object)
        time = work.column(order[0]).to_numpy()
        columns = {c: work.column(c).take(pa.array(at)) for c in order}
        columns["event_type"] = pa.array(names[rank], pa.string())
        columns["prev_t_us"] = pa.array(time[np.maximum(then, 0)], mask=then < 0)
        return columns, work.slice(last, 1)

    return ordered_stream(readings, keys, order, list(spec.deltas), delay_s, output, advance)


def heartbeat_stream(readings: DataFrame, seconds: float, keys: Sequence[str],
                     order: Sequence[str] = ("t_us",), delay_s: float = 60.0) -> DataFrame:
    """What a device sends that must not fall silent: its first reading, then at every
    ``seconds`` after the last send its newest reading, whether or not a new one came.

    The timer is event time: it fires when the watermark passes, so a silent device sends as
    long as any other one is heard. ``sent_us`` is the time of sending, ``order`` that of the
    reading that is sent.
    """
    micros = int(seconds * 1_000_000)
    kinds = dict(readings.dtypes)
    output = ", ".join(["sent_us bigint, event_type string",
                        *(f"`{c}` {kinds[c]}" for c in order)])
    next_due = "_next"

    def timer(carry: pa.RecordBatch) -> int:
        return carry.column(next_due)[0].as_py()

    def advance(carry, rows, mark):
        known = rows if carry is None else pa.Table.from_batches(
            [carry.select(list(order)), rows]).combine_chunks().to_batches()[0]
        time = known.column(order[0]).to_numpy()
        if not len(time):
            return {**{c: rows.column(c) for c in order}, "sent_us": pa.array([], pa.int64()),
                    "event_type": pa.array([], pa.string())}, carry
        begin = time[0] if carry is None else timer(carry)
        # All times due up to the watermark, each with the newest reading at that time.
        due = np.arange(begin, mark + 1, micros, dtype=np.int64)
        newest = np.searchsorted(time, due, "right") - 1
        names = np.full(len(due), "HEARTBEAT", dtype=object)
        if carry is None:
            names[:1] = "SAMPLE"
        columns = {c: known.column(c).take(pa.array(newest)) for c in order}
        columns |= {"sent_us": pa.array(due), "event_type": pa.array(names, pa.string())}
        after = begin + len(due) * micros
        last = known.slice(len(known) - 1, 1)
        return columns, pa.RecordBatch.from_arrays(
            [*last.columns, pa.array([after], pa.int64())], [*order, next_due])

    return ordered_stream(readings, keys, order, [], delay_s, output, advance, timer)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None],
                checkpoint: str) -> None:
    """Hand every micro-batch and its number to ``write`` and stop when all is done.

    A batch that was not committed is handed over again under its number, so ``write`` must
    leave the same behind for one number however often it is called.
    """
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; the file sink commits each micro-batch once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
