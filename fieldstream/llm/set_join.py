"""Exact Jaccard join of shingle sets by universe partitioning.

Sets are put into bands by size. In a band the universe of shingles is hashed into
``segments`` parts; two sets with similarity ``t`` or more differ in at most
``H = floor(hi * (1 - t) / t)`` shingles (``hi``: the band's largest size), so with more
segments than that some hold the same subset in both. Every non-empty subset is a key; some
bands also index what is left of a subset after one deletion, which makes a segment worth
two. How many segments and deletions a band uses is the cheapest choice (keys a set emits)
that leaves room for empty segments and for keys that very many sets share.

A key with many sets is not expanded: its sets are only compared with one centre. A set
that loses more keys in this way (or to empty segments) than its room allows is *unsafe*;
pairs of unsafe sets under one such key are compared too unless they are already connected.
A pair of similar sets thus always meets under a key, or both are unsafe and meet there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep, maybe_broadcast, small_batches
from fieldstream.llm.components import components

#: Similarity as a fraction: 100 * common >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
RATIO = 1.3          # size of a band
LEAST = 4            # smaller sets have no similar set but equal ones
MANY = 16            # a key with more sets is compared with its centre only
SKETCH_BITS = 1024
KEYS_A_BUCKET = 1_000_000
KEYS_AT_ONCE = 400_000  # keys that a task packs at once
TILE = 2048          # sets of one list that meet another such tile in a group
U64 = np.uint64

LISTS = "list_id long, rep long, center long, inner boolean, room int, hot boolean"


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    most_apart: int
    segments: int
    deletions: int  # the first so many segments index one-deletions

    @property
    def margin(self) -> int:
        return self.segments + self.deletions - self.most_apart - 1


@lru_cache(maxsize=None)
def band_edges(upto: int) -> tuple[int, ...]:
    edges = [LEAST]
    while edges[-1] <= upto:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * RATIO)))
    return tuple(edges)


def band_of(size: int) -> int:
    edges = band_edges(1 << max(8, int(size).bit_length()))
    return int(np.searchsorted(edges, size, "right")) - 1


@lru_cache(maxsize=None)
def band(index: int) -> Band:
    """The cheapest allocation of segments and deletions for a band of sizes."""
    edges = band_edges(1 << 8)
    while len(edges) < index + 2:
        edges = band_edges(edges[-1] * 4)
    low, high = edges[index], edges[index + 1] - 1
    apart = high * (DENOMINATOR - NUMERATOR) // NUMERATOR
    best = None
    step = max(1, high // 400)
    for m in range(1, high + 2, step):
        empty = m * (1 - 1 / m) ** low
        lone = low * (1 - 1 / m) ** (low - 1) if m > 1 else float(low == 1)
        for u in {0, m // 2, m}:
            risk = empty * (1 + u / m) + lone * u / m
            room = m + u - apart - 1
            if room >= risk + 2.5 * math.sqrt(risk) + m // 10:
                cost = m + u * low / m
                if best is None or cost < best[0]:
                    best = (cost, m, u)
        if best is not None and m > 4 * best[1]:
            break
    if best is None:  # no choice leaves room: fewest segments, all with deletions
        m = (apart + 2) // 2
        best = (0.0, m, m)
    return Band(low, high, apart, best[1], best[2])


def _emit(sets: list[np.ndarray], reps: np.ndarray, bands: np.ndarray, inner: bool
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their sets' ids, roles and rooms, of sets under the given bands."""
    chosen = [band(int(b)) for b in bands]
    size = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    m = np.array([b.segments for b in chosen], dtype=np.int64)
    u = np.array([b.deletions for b in chosen], dtype=np.int64)
    margin = np.array([b.margin for b in chosen], dtype=np.int64)
    tag = K.mix(bands.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(17))
    value = K.mix(tokens + tag[owner])
    segment = ((value >> U64(32)) * m[owner].astype(U64) >> U64(32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(m)])
    cell = base[owner] + segment
    sums = np.zeros(int(base[-1]), dtype=U64)
    np.add.at(sums, cell, value)
    held = np.bincount(cell, minlength=int(base[-1]))
    cell_owner = np.repeat(np.arange(len(sets)), m)
    place = np.arange(int(base[-1])) - base[cell_owner]
    double = place < u[cell_owner]
    risk = np.bincount(cell_owner, ((held == 0) * (1 + double) + ((held == 1) & double))
                       .astype(np.float64), minlength=len(sets)).astype(np.int64)
    room = margin - risk
    # A lost key of a band with deletions may stand for a segment that is worth two.
    room = np.clip(np.where((u > 0) & (room > 0), room // 2, room), -1, 120)
    name = K.mix(place.astype(U64) * U64(0xA0761D6478BD642F) + tag[cell_owner])
    full = held > 0
    keys, owners = [K.mix(sums[full] ^ name[full])], [cell_owner[full]]
    less = double[cell] & (held[cell] > 1)
    if less.any():
        keys.append(K.mix((sums[cell[less]] - value[less]) ^ name[cell[less]]))
        owners.append(owner[less])
    short = (room < 0)[owner]
    if short.any():  # too many empty segments: every shingle of the set is a key
        keys.append(K.mix(value[short] + U64(0x165667B19E3779F9)))
        owners.append(owner[short])
    at = np.concatenate(owners)
    return (np.concatenate(keys), reps[at], np.full(len(at), inner), room[at].astype(np.int8))


def set_keys(sets: list[np.ndarray], reps: np.ndarray):
    """All keys of some sets: of their own band, and of the band below for smaller partners."""
    size = np.array([len(x) for x in sets])
    use = np.flatnonzero(size >= LEAST)
    if not len(use):
        return None
    own = np.array([band_of(int(n)) for n in size[use]])
    picked = [sets[i] for i in use]
    parts = [_emit(picked, reps[use], own, True)]
    low = np.array([band(int(b)).low for b in own])
    below = np.flatnonzero((own > 0) & (
        -(-NUMERATOR * size[use] // DENOMINATOR) < low))
    if len(below):
        parts.append(_emit([picked[i] for i in below], reps[use][below], own[below] - 1, False))
    return tuple(np.concatenate(x) for x in zip(*parts))


def class_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set (0 for an empty one)."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    out = []
    for salt in (U64(0x8CB92BA72F3D8DD7), U64(0x2545F4914F6CDD1D)):
        running = np.concatenate([np.zeros(1, U64), np.cumsum(K.mix(tokens ^ salt))])
        total = running[at[1:]] - running[at[:-1]] + size.astype(U64)
        out.append(np.where(size > 0, K.mix(total), U64(0)).view(np.int64))
    return out[0], out[1]


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    raw, offsets = K.text_bytes(column)
    for a, b in K.runs(offsets):
        words = K.Words(K.LOWER[raw[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a])
        yield a, K.shingle_sets(words, words.hashes())


def _sketch(tokens: np.ndarray) -> bytes:
    """Parity of the set's shingles in cells: sets that differ in d shingles differ in at
    most d bits. Larger sets have more cells, by powers of four, so the bound stays sharp."""
    bits = SKETCH_BITS
    while 2 * bits < 3 * len(tokens) and bits < 1 << 20:
        bits *= 4
    cell = (K.mix(tokens ^ U64(0x9FB21C651E98DF25)) & U64(bits - 1)).astype(np.int64)
    odd = np.bincount(cell, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches brought to the fewest cells among them (cells that meet add up modulo 2)."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), U64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, size // 8), axis=0)
    return out


def digests(docs: DataFrame) -> DataFrame:
    """(id, n, a, b, sketch) of (id, text): set size, the set's digest and its parities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch.column(1)):
                a, b = class_ids(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sets)),
                     pa.array([len(x) for x in sets], pa.int64()), pa.array(a), pa.array(b),
                     pa.array([_sketch(x) if len(x) >= LEAST else None for x in sets],
                              pa.binary())], ["id", "n", "a", "b", "sketch"])

    return docs.mapInArrow(K.tidy(run), "id long, n long, a long, b long, sketch binary")


def _group(order_key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], order_key[1:] != order_key[:-1]]))


def _packed(parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """One row per bucket (and per bucket of hot keys) of some emitted keys."""
    rows: list[tuple] = []
    key, rep, inner, room = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    start = _group(key[order])
    count = np.diff(np.append(start, len(key)))
    hot = np.flatnonzero(count > MANY)
    gone = np.zeros(len(key), dtype=bool)
    flag = inner.astype(np.uint8)
    for g in hot.tolist():
        at = order[start[g]:start[g] + count[g]]
        own = at[inner[at]]
        if not len(own):
            continue
        center = own[np.argmin(rep[own])]
        gone[at] = True
        gone[center] = False
        flag[center] |= 2
        to = ((K.mix(rep[at].view(U64) ^ key[at]) >> U64(40)) % U64(buckets)).astype(np.int64)
        for b in np.unique(to).tolist():
            mine = at[to == b]
            rows.append((b, 1, np.append(key[mine], rep[center].view(U64)).tobytes(),
                         rep[mine].tobytes(), flag[mine].tobytes(), room[mine].tobytes()))
    left = np.flatnonzero(~gone)
    bucket = ((key[left] >> U64(40)) % U64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    left, bucket = left[by], bucket[by]
    edge = np.append(_group(bucket), len(bucket))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        mine = left[a:b]
        rows.append((int(bucket[a]), 0, (key[mine] & U64(0xFFFFFFFF)).astype(np.uint32)
                     .tobytes(), rep[mine].tobytes(), flag[mine].tobytes(),
                     room[mine].tobytes()))
    return pa.RecordBatch.from_pandas(pd.DataFrame(
        rows, columns=["bucket", "kind", "keys", "reps", "flags", "rooms"]),
        schema=pa.schema([("bucket", pa.int32()), ("kind", pa.int32()),
                          ("keys", pa.binary()), ("reps", pa.binary()),
                          ("flags", pa.binary()), ("rooms", pa.binary())]))


def _spread_keys(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, keys, reps, flags, rooms): the keys of all sets as packed arrays.

    A task emits a set once, however many copies it reads. A key that more than MANY sets
    of one pack share goes on as its centre alone (kind 0, flag 2); its sets go, with that
    centre, to buckets of their own choice (kind 1), so no bucket gets a hot key whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[tuple] = []
        size = 0
        for batch in batches:
            for _, sets in _sets(batch.column(0)):
                ids, _ = class_ids(sets)
                fresh = []
                for i, c in enumerate(ids.tolist()):
                    if len(sets[i]) >= LEAST and c not in seen:
                        seen.add(c)
                        fresh.append(i)
                got = set_keys([sets[i] for i in fresh], ids[fresh]) if fresh else None
                if got is not None:
                    parts.append(got)
                    size += len(got[0])
                if size >= KEYS_AT_ONCE:
                    yield _packed(parts, buckets)
                    parts, size = [], 0
        if parts:
            yield _packed(parts, buckets)

    return docs.mapInArrow(
        K.tidy(run), "bucket int, kind int, keys binary, reps binary, flags binary, rooms binary")


def _hot_list(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    return K.mix(key.astype(U64) + bucket.astype(U64) * U64(0x9E3779B97F4A7C15)
                 + U64(3)).view(np.int64)


def _lists(spread: DataFrame, buckets: int) -> DataFrame:
    """The sets under each key that two or more share, each with the key's centre."""
    def run(group: tuple, table: pa.Table) -> pa.Table:
        bucket = group[0].as_py()
        out: list[tuple] = []
        kinds = np.array(table["kind"].to_pylist())
        columns = {c: table[c].to_pylist() for c in ("keys", "reps", "flags", "rooms")}
        for i in np.flatnonzero(kinds == 1).tolist():
            key = np.frombuffer(columns["keys"][i], U64)
            rep = np.frombuffer(columns["reps"][i], np.int64)
            ids = _hot_list((key[:-1] >> U64(40)) % U64(buckets), key[:-1] & U64(0xFFFFFFFF))
            out.append((ids, rep, np.full(len(rep), key[-1:].view(np.int64)[0]),
                        (np.frombuffer(columns["flags"][i], np.uint8) & 1).astype(bool),
                        np.frombuffer(columns["rooms"][i], np.int8).astype(np.int32),
                        np.ones(len(rep), bool)))
        plain = np.flatnonzero(kinds == 0).tolist()
        if plain:
            key = np.concatenate([np.frombuffer(columns["keys"][i], np.uint32) for i in plain])
            ranked = np.sort(key)
            twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
            picked = np.flatnonzero(np.isin(key, twice, kind="sort"))
            rep = np.concatenate([np.frombuffer(columns["reps"][i], np.int64)
                                  for i in plain])[picked]
            flag = np.concatenate([np.frombuffer(columns["flags"][i], np.uint8)
                                   for i in plain])[picked]
            room = np.concatenate([np.frombuffer(columns["rooms"][i], np.int8)
                                   for i in plain])[picked].astype(np.int32)
            key = key[picked]
            # Once per key and set, the flags of repeats joined.
            order = np.lexsort((rep, key))
            key, rep, flag, room = key[order], rep[order], flag[order], room[order]
            if len(key):
                fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])])
                at = np.flatnonzero(fresh)
                flag = np.bitwise_or.reduceat(flag, at)
                key, rep, room = key[at], rep[at], room[at]
                # In each key's run the least set that is in its own band comes first.
                order = np.lexsort((rep, (flag & 1) == 0, key))
                key, rep, flag, room = key[order], rep[order], flag[order], room[order]
                start = _group(key)
                count = np.diff(np.append(start, len(key)))
                hot = (count > MANY) | (np.bitwise_or.reduceat(flag, start) & 2 > 0)
                small = K.mix(np.add.reduceat(K.mix(rep.view(U64)), start)
                              + count.astype(U64)).view(np.int64)
                ids = np.where(hot, _hot_list(np.full(len(start), bucket), key[start]), small)
                of = np.repeat(np.arange(len(start)), count)
                good = (((flag[start] & 1) > 0) & ((count > 1) | hot))[of]
                first = np.zeros(len(key), bool)
                first[start] = True
                good &= ~(first & (count[of] == 2) & ~hot[of])  # a pair needs no second row
                out.append((ids[of][good], rep[good], rep[start][of][good],
                            (flag[good] & 1).astype(bool), room[good], hot[of][good]))
        names = ["list_id", "rep", "center", "inner", "room", "hot"]
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
        if not out:
            return pa.table([pa.array([], k) for k in kinds_of], names=names)
        ids, rep, center, inner, room, hot = (np.concatenate(x) for x in zip(*out))
        # Lists of the same sets, met under several keys of the bucket, are one list; hot keys
        # are counted one by one.
        once = np.unique(np.stack([ids, rep], 1), axis=0, return_index=True)[1]
        K.release()
        return pa.table([pa.array(x[once], k) for x, k in zip(
            (ids, rep, center, inner, room, hot), kinds_of)], names=names)

    return spread.groupBy("bucket").applyInArrow(run, LISTS)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame,
           members: int = 256) -> DataFrame:
    """The pairs (a, b) of set ids that are similar, by their whole sets.

    A pair first has to pass the parities (they never reject a similar pair). The sets of
    the rest are read again from the texts and meet at ``a``, in groups of about ``members``
    partners, so a set with very many partners is many groups.
    """
    left = classes.select(F.col("a").alias("__a"), F.col("n").alias("na"),
                          F.col("sketch").alias("sa"), F.col("doc").alias("da"))
    right = left.toDF("__b", "nb", "sb", "db")

    @F.arrow_udf("int")
    def apart(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.empty(len(x), np.int32)
        for i, both in enumerate(zip(x.to_pylist(), y.to_pylist())):
            one, two = _folded(list(both))
            out[i] = np.bitwise_count(one ^ two).sum()
        return pa.array(out)

    near = keep(
        pairs.join(left, F.col("a") == F.col("__a")).join(right, F.col("b") == F.col("__b"))
        .where((DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))
               & (NUMERATOR * apart("sa", "sb")
                  <= (DENOMINATOR - NUMERATOR) * F.least("na", "nb")))
        .select("a", "b", "da", "db"), "near-pairs")
    load = near.groupBy(F.col("a").alias("__c")).agg(
        F.ceil(F.count("*") / members).cast("int").alias("parts"), F.first("da").alias("da"))
    load = keep(load, "pair-load")
    dealt = near.join(load.drop("da"), F.col("a") == F.col("__c")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b",
        F.col("db").alias("doc"))
    centers = load.select(F.col("__c").alias("a"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"), F.col("da").alias("doc"))
    wanted = keep(dealt.unionByName(centers), "wanted-sets")
    rows = wanted.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            for at, sets in _sets(texts):
                ids, _ = class_ids(sets)
                part = batch.slice(at, len(sets))
                want = [b if b is not None else a for a, b in zip(
                    part.column(0).to_pylist(), part.column(2).to_pylist())]
                right_text = pa.array([w == i for w, i in zip(want, ids.tolist())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2),
                     pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["a", "part", "b", "tokens"]).filter(right_text)

    # The join is by document; ids that several texts share are told apart by the set's id.
    found = (docs.join(maybe_broadcast(wanted, rows, 1_000_000), docs["id"] == wanted["doc"])
             .select("a", "part", "b", "text")
             .mapInArrow(K.tidy(read), "a long, part long, b long, tokens binary"))

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        b = table["b"].to_pylist()
        sets = table["tokens"].to_pylist()
        middle = next((np.frombuffer(s, U64) for k, s in zip(b, sets) if k is None), None)
        hits = sorted({k for k, s in zip(b, sets) if k is not None and middle is not None
                       and _similar(middle, np.frombuffer(s, U64))})
        return pa.table([pa.array([group[0].as_py()] * len(hits), pa.int64()),
                         pa.array(hits, pa.int64())], names=["a", "b"])

    return found.groupBy("a", "part").applyInArrow(compare, "a long, b long")


def _torn(met: DataFrame, found: DataFrame) -> DataFrame:
    """(list_id, rep, inner, c) of the lists whose sets are in several components."""
    marked = (met.join(found.withColumnRenamed("node", "__node"),
                       F.col("rep") == F.col("__node"), "left")
              .select("list_id", "rep", "inner", F.coalesce("component", "rep").alias("c")))
    several = (marked.groupBy("list_id").agg(F.min("c").alias("x"), F.max("c").alias("y"))
               .where("x <> y").select(F.col("list_id").alias("__list")))
    return marked.join(several, F.col("list_id") == F.col("__list"), "left_semi")


def _cross(torn: DataFrame) -> DataFrame:
    """All pairs of a list's sets that are in different components."""
    other = torn.toDF("__list", "r2", "i2", "c2")
    return (torn.join(other, F.col("list_id") == F.col("__list"))
            .where((F.col("rep") < F.col("r2")) & (F.col("c") != F.col("c2"))
                   & (F.col("inner") | F.col("i2")))
            .select(F.col("rep").alias("a"), F.col("r2").alias("b")))


def _near_in_lists(torn: DataFrame, classes: DataFrame, every: bool) -> DataFrame:
    """Pairs of hot lists' sets in different components that the parities do not rule out.

    All sets of a list are compared by their parities (one bit per shingle cell, exact lower
    bound of the difference) inside tasks. Lists above TILE sets are cut into tiles, a pair
    of tiles is one group, so no group outgrows two tiles. Without ``every`` a set gives only
    its nearest pair of a group.
    """
    size = torn.groupBy(F.col("list_id").alias("__list")).agg(
        F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = (torn.join(size, F.col("list_id") == F.col("__list"))
            .join(classes.select(F.col("a").alias("__a"), "n", "sketch"),
                  F.col("rep") == F.col("__a"))
            .withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")))
    packs = max(1, torn.count() // TILE)
    own = F.pmod(F.xxhash64("list_id"), F.lit(packs))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(
        F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    dealt = rows.withColumn("__p", F.explode(pair)).select(
        F.when(F.col("tiles") == 1, own).otherwise(F.col("list_id")).alias("pack"),
        (F.col("tiles") > 1).alias("cut"), "__p.i", "__p.j", "list_id", "rep", "inner", "c",
        "n", "sketch", "tile")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("list_id")
        ids, rep, c, n, tile = (table[k].to_numpy() for k in ("list_id", "rep", "c", "n", "tile"))
        inner = table["inner"].to_numpy()
        sketches = table["sketch"].to_pylist()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        edge = np.append(_group(ids), len(ids))
        found: list[np.ndarray] = []

        def meet(left: np.ndarray, right: np.ndarray, bits: np.ndarray, lo: int
                 ) -> Iterator[np.ndarray]:
            for k in range(0, len(left) if len(right) else 0, 64):
                x = left[k:k + 64]
                apart = np.zeros((len(x), len(right)), np.int32)
                for w in range(bits.shape[1]):
                    apart += np.bitwise_count(
                        bits[x - lo, w][:, None] ^ bits[right - lo, w][None, :])
                small = np.minimum(n[x][:, None], n[right][None, :])
                large = np.maximum(n[x][:, None], n[right][None, :])
                good = ((NUMERATOR * apart <= (DENOMINATOR - NUMERATOR) * small)
                        & (DENOMINATOR * small >= NUMERATOR * large)
                        & (c[x][:, None] != c[right][None, :])
                        & (inner[x][:, None] | inner[right][None, :]))
                if not every:
                    has = np.flatnonzero(good.any(axis=1))
                    at = np.where(good[has], apart[has], 1 << 20).argmin(axis=1)
                    yield np.stack([rep[x[has]], rep[right[at]]], 1)
                else:
                    u, v = np.nonzero(good)
                    yield np.stack([rep[x[u]], rep[right[v]]], 1)

        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            bits = _folded(sketches[lo:hi])
            left = lo + np.flatnonzero(tile[lo:hi] == i)
            right = lo + np.flatnonzero(tile[lo:hi] == j)
            # Two sets of one component need no comparison: the sets of the most frequent one
            # only meet the others.
            part, size = np.unique(c[lo:hi], return_counts=True)
            main = part[np.argmax(size)]
            for x, y in ((left[c[left] == main], right[c[right] != main]),
                         (left[c[left] != main], right)):
                found += meet(x, y, bits, lo)
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()),
                         "b": pa.array(pairs[:, 1], pa.int64())})

    return dealt.groupBy("pack", "cut", "i", "j").applyInArrow(compare, "a long, b long")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row.

    Words are lower-cased in A-Z and cut at ASCII white space; a set holds the distinct
    5-word shingles, or the whole word sequence of a shorter text. Two documents link when
    100 * common >= 80 * union; ``component_id`` is the least id that links lead to, its own
    included. A null or empty text and one without words has the size 0 and no link. Rows
    without an id link to nothing and get a null component. Repeated rows are one document;
    rows that share an id but not a text are joined as separate documents with that id.
    """
    whole = small_batches(docs).select(F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("string").alias("text"))
    slim = keep(digests(whole), "set-digests")
    known = slim.where(F.col("id").isNotNull() & (F.col("n") >= 1))
    classes = keep(known.groupBy("a", "b").agg(
        F.min("id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .drop("b"), "set-classes")
    total = slim.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(0.6 * total / KEYS_A_BUCKET))
    named = whole.where(F.col("id").isNotNull())
    lists = keep(_lists(_spread_keys(named.select("text"), buckets), buckets).distinct(),
                 "key-lists")
    stars = lists.where("rep <> center").select(
        F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = keep(verify(stars, named, classes), "star-links")
    found = keep(components(links), "components")

    # Sets that met under a key but are not connected yet: all sets of a short list, and
    # the unsafe sets of a hot one.
    lost = lists.where("hot").groupBy("rep", "inner").agg(
        F.count_distinct("list_id").alias("lost"), F.min("room").alias("room"))
    unsafe = lost.where("room < lost").select(
        F.col("rep").alias("__rep"), F.col("inner").alias("__inner"))
    hot = lists.where("hot").join(
        unsafe, (F.col("rep") == F.col("__rep")) & (F.col("inner") == F.col("__inner")),
        "left_semi")
    short = lists.where("not hot").select("list_id", "rep", "inner")
    hot = keep(hot.select("list_id", "rep", "inner"), "hot-lists")
    tried = stars.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    # First the nearest pairs, which connect most; then all that are left.
    for every in (False, True):
        torn = keep(_torn(hot, found), "torn")
        near = _near_in_lists(torn, classes, every)
        if not every:
            near = near.unionByName(_cross(_torn(short, found)))
        rest = keep(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct().join(tried, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")),
                                     "left_anti"), "rest-pairs")
        if not rest.limit(1).count():
            continue
        more = keep(verify(rest, named, classes), "rest-links")
        if more.limit(1).count():
            links = links.unionByName(more)
            found = keep(components(links), "components")
        tried = tried.unionByName(rest.toDF("x", "y"))

    roots = (found.join(classes.select(F.col("a").alias("__a"), "doc"),
                        F.col("node") == F.col("__a"))
             .groupBy("component").agg(F.min("doc").alias("least")))
    linked = found.join(roots.withColumnRenamed("component", "__c"),
                        F.col("component") == F.col("__c")).select("node", "least")
    best = keep(classes.select("a", "doc").join(linked, F.col("a") == F.col("node"), "left")
                .select(F.col("a").alias("__a"), F.coalesce("least", "doc").alias("least")),
                "class-components")
    return (slim.join(best, (F.col("a") == F.col("__a")) & F.col("id").isNotNull()
                      & (F.col("n") > 0), "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("least", "id").alias("component_id")))
