"""Ordered operators: the same result with and without cut keys, and as a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from fieldstream.operators import assembly, health, loss, sampling, send_policy
from fieldstream.operators.timeline import Timeline
from fieldstream.plans.policies import PolicySpec, ShuntPolicy
from fieldstream.sources import shunt_text

S = 1_000_000
LIMITS = [None, 40, 7]          # no hot key; the biggest ones; nearly all


def rows(n=900, seed=3):
    """A third of the rows belongs to one key; times are uneven with ties."""
    rng = random.Random(seed)
    out, clock = [], {}
    for i in range(n):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 12)
        clock[key] = clock.get(key, 0) + rng.choice([0, 1, 1, 2, 3, 40]) * S
        value = rng.choice([None, 0, 1, 5, rng.randrange(-50, 50)])
        out.append((key, clock[key], i, value, rng.random() < 0.8, rng.choice("ab")))
    rng.shuffle(out)
    return out


SCHEMA = "k int, t_us long, i long, v int, ok boolean, s string"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def per_key():
    keys = {}
    for r in sorted(rows(), key=lambda r: (r[0], r[1], r[2])):
        keys.setdefault(r[0], []).append(r)
    return keys


def ids(df, *columns):
    return sorted(tuple(r[c] for c in ("i", *columns)) for r in df.collect())


def test_hot_keys_are_found(data):
    assert not Timeline(data, ["k"], ["t_us", "i"]).split
    assert Timeline(data, ["k"], ["t_us", "i"], 40).split


@pytest.mark.parametrize("limit", LIMITS)
def test_scan(data, limit):
    got = Timeline(data, ["k"], ["t_us", "i"], limit).scan(
        lag=("lag", F.col("v")), total=("sum", F.col("v")), before=("before", F.col("v")),
        nth=("count", F.lit(1)), last=("last", F.col("v")), earlier=("earlier", F.col("v")),
        low=("min", F.col("v"))).rows
    want = []
    for group in per_key().values():
        total = low = last = lag = None
        before = 0
        for n, (_, _, i, v, _, _) in enumerate(group):
            earlier = last
            if v is not None:
                total, low, last = (total or 0) + v, v if low is None else min(low, v), v
            want.append((i, lag, total, before, n + 1, last, earlier, low))
            before, lag = before + (v or 0), v
    assert ids(got, "lag", "total", "before", "nth", "last", "earlier", "low") == sorted(
        want, key=lambda r: r[0])


def loop(decide, accepted=lambda r: True):
    out = []
    for group in per_key().values():
        state = None
        for r in group:
            event = decide(state, r)
            if event:
                out.append((r[2], event, None if state is None else state[1]))
                if accepted(r):
                    state = r
    return sorted(out)


def band(state, r):
    if state is None:
        return "DELTA_UPDATE"
    a, b = r[3], state[3]
    if (a is None) != (b is None) or r[5] != state[5]:
        return "DELTA_UPDATE"
    if a is not None and ((a == 0) != (b == 0) or abs(a - b) >= 20):
        return "DELTA_UPDATE"
    return "HEARTBEAT" if r[1] - state[1] >= 30 * S else None


SPEC = PolicySpec(deltas={"v": 20.0, "s": 1.0}, heartbeat_s=30)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("ok", [None, "ok"])
def test_deadband(data, limit, ok):
    got = send_policy.deadband(data, SPEC, ["k"], ["t_us", "i"], ok=ok, limit=limit)
    want = loop(band, (lambda r: r[4]) if ok else (lambda r: True))
    assert ids(got, "event_type", "prev_t_us") == want


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("seconds", [0.5, 5, 100_000])
def test_spacing(data, limit, seconds):
    got = send_policy.status_throttle(data, ["k"], ["t_us", "i"], seconds, limit=limit)
    want = loop(lambda s, r: s is None or r[1] - s[1] >= seconds * S)
    assert ids(got, "prev_t_us") == [(i, p) for i, _, p in want]


@pytest.mark.parametrize("limit", LIMITS)
def test_shunt_events(data, limit):
    shaped = data.selectExpr(
        "k", "t_us", "i", "ok", "v * 10 voltage_mv", "0 current_ma", "cast(null as int) power_w",
        "cast(i % 7 / 4 as double) charge_state", "if(i % 19 = 0, 2, 0) alarm")

    def decide(s, r):
        if s is None:
            return "SAMPLE"
        alarm = [2 if x[2] % 19 == 0 else 0 for x in (r, s)]
        if alarm[0] != alarm[1] and alarm[0]:
            return "ALARM"
        if round(r[2] % 7 / 4) != round(s[2] % 7 / 4):
            return "THRESHOLD_CROSSING"
        if abs((r[3] or 0) * 10 - (s[3] or 0) * 10) >= 200:
            return "DELTA_UPDATE"
        return "HEARTBEAT" if r[1] - s[1] >= 20 * S else None

    got = send_policy.classify_shunt(
        shaped, ShuntPolicy(200, 10, 10, 20.0), ["k"], ["t_us", "i"], ok="ok", limit=limit)
    assert ids(got, "event_type", "prev_t_us") == loop(decide, lambda r: r[4])


def test_policy_names_unknown_columns(data):
    with pytest.raises(ValueError, match="nope"):
        send_policy.deadband(data, PolicySpec({"nope": 1.0}, 5), ["k"])


@pytest.mark.parametrize("partitions", [1, 7])
def test_partitions_do_not_matter(spark, data, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for limit in (None, 7):
            shuffled = data.repartition(5, F.rand(1))
            got = send_policy.deadband(shuffled, SPEC, ["k"], ["t_us", "i"], limit=limit)
            assert ids(got, "event_type", "prev_t_us") == loop(band)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("limit", LIMITS)
def test_loss(spark, limit):
    rng = random.Random(8)
    packets, seq = [], {}
    for arrival in range(600):
        kind = rng.choice(["BMV", "BMV", "RTD"])
        seq[kind] = (seq.get(kind, 65_400) + rng.choice([1, 1, 1, 2, 5, 0, 5000, -3])) % 65_536
        packets.append((1 if arrival % 3 else arrival % 5, kind, arrival, seq[kind]))
    df = spark.createDataFrame(packets, "session_id int, msg_type string, arrival long, seq int")
    last, totals, want = {}, {}, []
    for session, kind, arrival, number in packets:
        got, lost = totals.get(session, (0, 0))
        gap = (number - last[session, kind] - 1) % 65_536 if (session, kind) in last else 0
        counted = gap if 0 < gap < 0x1000 else 0
        totals[session] = (got + 1, lost + counted)
        if counted:
            want.append((arrival, counted, *totals[session]))
        last[session, kind] = number
    running = loss.running_loss(df, ["session_id"], limit=limit).collect()
    assert sorted((r["arrival"], r["lost"], r["received"], r["total_lost"])
                  for r in running) == want
    overall = loss.session_loss(df, ["session_id"], limit=limit).collect()
    assert {r["session_id"]: (r["received"], r["lost"]) for r in overall} == totals


def test_wrap_and_repeat(spark):
    df = spark.createDataFrame(
        [(1, "BMV", n, s) for n, s in enumerate([65_535, 0, 0, 3])],
        "session_id int, msg_type string, arrival long, seq int")
    got = loss.sequence_gaps(df, ["session_id"]).orderBy("arrival").collect()
    assert [(r["gap"], r["lost"]) for r in got] == [(None, 0), (0, 0), (65_535, 0), (2, 2)]


@pytest.mark.parametrize("limit", LIMITS)
def test_peak_and_runs(data, limit):
    peaks, runs = [], []
    for group in per_key().values():
        peak, run = None, 0
        for _, _, i, v, ok, _ in group:
            if v is not None and v < 0:
                peak = v if peak is None else min(peak, v)
            peaks.append((i, peak))
            run = 0 if ok else run + 1
            if run:
                runs.append((i, run, min(2.0 * run, 10.0), run >= 3))
            if ok:
                peak = None
    got = sampling.peak_hold(data, ["k"], ["t_us", "i"], current="v", sent_ok="ok", limit=limit)
    assert ids(got, "peak_current_ma") == sorted(peaks)
    got = health.error_runs(data, ["k"], ["t_us", "i"], give_up=3, limit=limit)
    assert ids(got, "consecutive", "backoff_s", "gives_up") == sorted(runs)


@pytest.mark.parametrize("limit", LIMITS)
def test_latest_at_ticks(spark, data, limit):
    ticks = [(k, t * S) for k in range(13) for t in range(0, 900, 11)]
    df = spark.createDataFrame(ticks, "k int, tick_us long")
    want, keys = [], per_key()
    for k, tick in ticks:
        seen = [r for r in keys.get(k, []) if r[1] <= tick]
        if seen:
            want.append((k, tick, seen[-1][1], (tick - seen[-1][1]) / S))
    unique = data.groupBy("k", "t_us").agg(F.max("i").alias("i"))
    got = sampling.latest_at_ticks(unique, df, ["k"], ["i"], limit=limit)
    assert sorted((r["k"], r["tick_us"], r["t_us"], r["staleness_s"])
                  for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("limit", LIMITS)
def test_priority(data, limit):
    due = data.withColumn("priority", F.pmod("i", F.lit(4)))
    want = []
    for group in per_key().values():
        ordered = sorted((r[2] % 4, r[2]) for r in group)
        want += [(i, n + 1) for n, (_, i) in enumerate(ordered)]
    got = assembly.priority_rank(due, ["k"], "i", limit=limit)
    assert ids(got, "send_rank") == sorted(want)
    first = assembly.next_to_send(due, ["k"], "i")
    assert sorted(r["i"] for r in first.collect()) == sorted(i for i, n in want if n == 1)


@pytest.mark.parametrize("limit", LIMITS)
def test_round_robin(spark, limit):
    rng = random.Random(4)
    due = [(s, t, slot, rng.choice([0, 0, 20, 45, 60, 90]))
           for s in (1, 1, 2) for t in range(60) for slot in rng.sample(range(9), rng.randrange(1, 6))]
    due = list({(s, t, slot): (s, t, slot, n) for s, t, slot, n in due}.values())
    df = spark.createDataFrame(due, "session_id int, tick long, slot int, packet_bytes int")
    want = []
    for session in (1, 2):
        start, ring = 0, []
        for tick in range(60):
            now = {k: n for s, t, k, n in sorted(due) if (s, t) == (session, tick)}
            if not now:
                continue
            ring += [k for k in now if k not in ring]
            sizes = [now.get(k, 0) for k in ring]
            at, used, picked = start % len(sizes), 2, []
            for _ in range(len(sizes)):
                if len(picked) == 4:
                    break
                slot, at = at, (at + 1) % len(sizes)
                if sizes[slot]:
                    if used + 1 + sizes[slot] > 180:
                        break
                    used += 1 + sizes[slot]
                    picked.append(slot)
            start = at
            want += [(session, tick, n, ring[at]) for n, at in enumerate(picked)]
    got = assembly.pick_batches(df, ["session_id"], slots=9, limit=limit)
    assert sorted((r["session_id"], r["tick"], r["frame_pos"], r["slot"])
                  for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("limit", [None, 30, 8])
def test_frames_of_cut_sessions(spark, limit):
    rng = random.Random(6)
    lines, want = [], []
    for session in (1, 2):
        held, no = {}, 0
        for block in range(120 if session == 1 else 15):
            pairs = {k: str(rng.randrange(99)) for k in rng.sample(["V", "I", "P", "H1"],
                                                                   rng.randrange(1, 5))}
            good = rng.random() < 0.9
            raw = [f"{k}\t{v}\r\n".encode() for k, v in pairs.items()] + [b"Checksum\t"]
            check = (-sum(map(sum, raw)) - 23 + (not good)) % 256
            raw[-1] += bytes([check]) + b"\r\n"
            for line in raw:
                lines.append((session, no, line))
                no += 1
            if good:
                held.update(pairs)
                if {"V", "I", "P"} <= held.keys():
                    want.append((session, block, tuple(sorted(held.items()))))
                    held = {}
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "session_id int, line_no long, raw binary")
    blocks = shunt_text.text_blocks(df, ["session_id"], limit=limit)
    frames = shunt_text.text_frames(blocks, ["session_id"], limit=limit)
    assert sorted((r["session_id"], r["end_block"], tuple(sorted(
        (k, v) for k, v in r["fields"].items() if k != "Checksum")))
        for r in frames.collect()) == sorted(want)


def test_drive_timer_is_strict(spark):
    df = spark.createDataFrame(
        [(1, 0, -0.5), (1, 5 * S, -0.51), (1, 7 * S + 999_999, 0.0), (2, 3 * S, -0.5)],
        "session_id int, t_us long, current_a double")
    starts = sampling.drive_start(df, ["session_id"])
    got = sampling.stamp_elapsed(df, starts, ["session_id"]).orderBy("session_id", "t_us")
    assert [r["elapsed_s"] for r in got.collect()] == [0, 0, 2, 0]


@pytest.mark.parametrize("limit", [None, 8])
def test_running_sums_keep_their_type(spark, limit):
    df = spark.range(40).select(F.lit(1).alias("k"), "id", F.lit(0.5).alias("v"))
    rows = Timeline(df, ["k"], ["id"], limit).scan(ahead=("before", F.col("v"))).rows
    assert [r["ahead"] for r in rows.orderBy("id").collect()] == [0.5 * n for n in range(40)]


def test_slots_out_of_range_are_rejects(spark):
    df = spark.createDataFrame([(1, 0, 12, 20), (1, 0, 3, 20), (1, 0, None, 20), (1, 0, -1, 20)],
                               "session_id int, tick long, slot int, packet_bytes int")
    assert [r["slot"] for r in assembly.pick_batches(df, ["session_id"]).collect()] == [3]
    assert sorted(str(r["slot"]) for r in assembly.slot_rejects(df).collect()) == [
        "-1", "12", "None"]


@pytest.mark.parametrize("times", ["outlier", "one"])
def test_slices_have_about_the_same_number_of_rows(spark, times):
    """Equal widths would leave nearly all rows in one slice."""
    n = 20_000
    at = "CASE WHEN id = 0 THEN -1000000000000 ELSE id END" if times == "outlier" else "7L"
    df = spark.range(0, n, 1, 8).selectExpr("0 k", f"{at} t", "id i")
    line = Timeline(df, ["k"], ["t", "i"], 2_000)
    sizes = [r["count"] for r in line._rows.groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 2 * n / len(sizes)
    got = line.scan(nth=("count", F.lit(1))).rows.where("nth <> i + 1").count()
    assert got == 0


def test_rows_that_agree_in_the_whole_order_are_cut_too(spark):
    df = spark.range(0, 20_000, 1, 8).selectExpr("0 k", "7L t", "id v")
    line = Timeline(df, ["k"], ["t"], 2_000)
    sizes = [r["count"] for r in line._rows.groupBy("_slice").count().collect()]
    assert max(sizes) <= 4_000
    nth = line.scan(nth=("count", F.lit(1))).rows.select("nth").distinct().count()
    assert nth == 20_000


def test_many_rows_of_one_key_within_the_horizon(spark):
    """200,000 rows of which none is due: no pair of rows is compared one by one."""
    import time

    df = spark.range(0, 200_000, 1, 8).selectExpr(
        "0 k", "id t_us", "cast(id % 19 as double) v")
    spec = PolicySpec(deltas={"v": 18.5}, heartbeat_s=1.0)
    began = time.time()
    got = send_policy.deadband(df, spec, ["k"], limit=30_000).collect()
    assert time.time() - began < 60
    # Zero and not zero differ: every 19th row and the one after it.
    assert sorted(r["t_us"] for r in got) == [
        i for i in range(200_000) if i % 19 in (0, 1)]
