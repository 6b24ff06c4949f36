"""Benchmark items inside documents: fingerprints of item-sized windows.

A window with as many words as an item gets a 64-bit SimHash of its word shingles. An index
per window size finds all items within RADIUS bits: the fingerprint is cut into blocks, and
within that radius some block differs in at most ``RADIUS // BLOCKS`` bits, so every item is
entered under all block values that near. Candidates are verified by the exact similarity of
their weighted shingles (weight: how often one occurs; sum of minima over sum of maxima).
A document shorter than an item is compared as a whole where its shingles can suffice.

Windows without a single shingle of any item have similarity 0 and are not fingerprinted.
Words are runs of letters and digits by their Unicode class, lower-cased in A-Z; in scripts
without spaces every character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import small_batches

U64 = np.uint64
LEAST = 0.8
RADIUS = 23
BLOCKS = 8
WIDTH = 64 // BLOCKS
#: Items are indexed in blocks of so many; each block is one pass over the documents.
ITEMS_A_BLOCK = 20_000
#: Windows that are fingerprinted at once.
STRETCH = 4096


def _breaks() -> np.ndarray:
    table = K.not_letter()
    table[ord("0"):ord("9") + 1] = False
    return table


BREAKS = _breaks()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts in which ASCII alone ends words."""
    return K.text_bytes(pc.replace_substring_regex(
        K.blank(column, K.NO_WORDS), K.UNSPACED, r" \1 "))


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray]:
    words = K.Words(K.LOWER[raw], offsets, BREAKS)
    return words, words.hashes()


def fingerprints(shingles: np.ndarray, size: int, start: np.ndarray) -> np.ndarray:
    """SimHash of ``size`` neighbouring shingles from each start on."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    running = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=running[1:])
    votes = running[start + size] - running[start]
    return np.packbits(votes > 0, axis=1).view(U64).ravel()


def _values(prints: np.ndarray) -> np.ndarray:
    """The BLOCKS block values of each fingerprint (prints x BLOCKS)."""
    shift = (np.arange(BLOCKS) * WIDTH).astype(U64)
    return ((prints[:, None] >> shift) & U64((1 << WIDTH) - 1)).astype(np.int64)


def _near() -> np.ndarray:
    """Masks of at most RADIUS // BLOCKS bits of a block."""
    return np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1)
                     for c in combinations(range(WIDTH), k)], dtype=np.int64)


class Index:
    """The items of one block: their shingles, and fingerprints by window size."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        raw, offsets = _bytes(pa.array(texts, pa.string()))
        words, hashes = _words(raw, offsets)
        self.item: list[int] = []
        self.length: list[int] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        prints: list[int] = []
        owners: dict[int, list[np.ndarray]] = {}
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = b - a
            if not n or ids[k] is None:
                continue
            width = min(K.SHINGLE, n)
            shingles = K.windows(hashes[a:b], width)
            self.item.append(ids[k])
            self.length.append(n)
            self.counts.append(np.unique(shingles, return_counts=True))
            prints.append(int(fingerprints(shingles, len(shingles), np.zeros(1, np.int64))[0]))
            owners.setdefault(width, []).append(np.stack(
                [self.counts[-1][0], np.full(len(self.counts[-1][0]), n, U64)]))
        self.prints = np.array(prints, dtype=U64)
        #: by shingle width: sorted shingles of the items and the window sizes that have them
        self.anchors = {}
        for width, parts in owners.items():
            both = np.unique(np.concatenate(parts, axis=1), axis=1)
            quick = np.zeros(1 << 20, bool)
            quick[(both[0] >> U64(44)).astype(np.int64)] = True
            self.anchors[width] = (both[0], both[1].astype(np.int64), quick)
        self.by_size: dict[int, tuple[np.ndarray, list[list[np.ndarray]]]] = {}
        near = _near()
        for n in sorted(set(self.length)):
            own = np.flatnonzero(np.array(self.length) == n)
            value = _values(self.prints[own])
            table = []
            for block in range(BLOCKS):
                reach = (value[:, block, None] ^ near[None, :]).ravel()
                who = np.repeat(own, len(near))
                order = np.argsort(reach, kind="stable")
                edge = np.searchsorted(reach[order], np.arange((1 << WIDTH) + 1))
                table.append([edge, who[order]])
            self.by_size[n] = (own, table)

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS bits, each once."""
        value = _values(prints)
        windows, items = [], []
        for block, (edge, who) in enumerate(self.by_size[size][1]):
            a, b = edge[value[:, block]], edge[value[:, block] + 1]
            n = b - a
            windows.append(np.repeat(np.arange(len(prints)), n))
            items.append(who[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        window, item = np.concatenate(windows), np.concatenate(items)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        pair = np.unique(window[close] * len(self.item) + item[close])
        return pair // len(self.item), pair % len(self.item)

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        mine, weight = self.counts[item]
        other, found = np.unique(shingles, return_counts=True)
        _, a, b = np.intersect1d(mine, other, assume_unique=True, return_indices=True)
        least = int(np.minimum(weight[a], found[b]).sum())
        return least / (int(weight.sum()) + int(found.sum()) - least)

    def search(self, column: pa.Array) -> list[list[tuple[int, float, int]]]:
        """Per text: (item id, similarity, first word) of the best window of each item."""
        out: list[list[tuple[int, float, int]]] = []
        for _, some in K.slices(column):
            words, hashes = _words(*_bytes(some))
            best: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(some))]
            for width, (anchor, sizes, quick) in self.anchors.items():
                rolled = K.windows(hashes, width)
                maybe = np.flatnonzero(quick[(rolled >> U64(44)).astype(np.int64)])
                low = np.searchsorted(anchor, rolled[maybe], "left")
                high = np.searchsorted(anchor, rolled[maybe], "right")
                hit = maybe[high > low]
                low, high = low[high > low], high[high > low]
                doc = np.searchsorted(words.first, hit, "right") - 1
                for d in np.unique(doc).tolist():
                    mine = np.flatnonzero(doc == d)
                    begin, stop = int(words.first[d]), int(words.first[d + 1])
                    at = hit[mine]
                    inside = at + width <= stop
                    wanted: dict[int, list[int]] = {}
                    for p, i, j, ok in zip(at.tolist(), low[mine].tolist(),
                                           high[mine].tolist(), inside.tolist()):
                        if ok:
                            for n in set(sizes[i:j].tolist()):
                                wanted.setdefault(n, []).append(p)
                    for n, places in wanted.items():
                        self._windows(rolled, begin, stop, n, width, np.array(places), best[d])
            out.extend([(self.item[i], s, p) for i, (s, p) in sorted(b.items())] for b in best)
        K.release()
        return out

    def _windows(self, rolled: np.ndarray, begin: int, stop: int, n: int, width: int,
                 places: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        """Windows of ``n`` words that hold one of the places, within words begin to stop.

        A text of fewer words that can still be similar enough is one window itself.
        """
        if stop - begin < n:
            whole = stop - begin - width + 1
            if whole >= LEAST * (n - width + 1) - 1e-9:
                self._compare(rolled, np.array([begin]), whole, n, begin, best)
            return
        mark = np.zeros(stop - begin - n + 2, np.int64)
        np.add.at(mark, np.clip(places - (n - width) - begin, 0, len(mark) - 1), 1)
        np.add.at(mark, np.clip(places + 1 - begin, 0, len(mark) - 1), -1)
        starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0) + begin
        size = n - width + 1
        k = 0
        while k < len(starts):
            upto = int(np.searchsorted(starts, starts[k] + STRETCH))
            some = starts[k:upto]
            self._compare(rolled, some, size, n, begin, best)
            k = upto

    def _compare(self, rolled: np.ndarray, some: np.ndarray, size: int, n: int, begin: int,
                 best: dict[int, tuple[float, int]]) -> None:
        """The windows of ``size`` shingles from ``some`` on against the items of ``n`` words."""
        origin = int(some[0])
        prints = fingerprints(rolled[origin:int(some[-1]) + size], size, some - origin)
        for w, item in zip(*(x.tolist() for x in self.candidates(n, prints))):
            at = int(some[w])
            score = self.similarity(item, rolled[at:at + size])
            if score >= LEAST and (-score, at - begin) < (
                    -best.get(item, (0.0, 0))[0], best.get(item, (0.0, 0))[1]):
                best[item] = (score, at - begin)


def _indexes(bench: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """One index per block of at most about ITEMS_A_BLOCK items."""
    items = bench.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).toArrow()
        rows = sorted(zip(part["id"].to_pylist(), part["text"].to_pylist()),
                      key=lambda x: (x[0] is None, x))
        yield Index([x[0] for x in rows], [x[1] for x in rows])


def find(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, similarity, start_word): items that a document holds, best window.

    Documents and items without a word, null texts and items without an id match nothing.
    Repeated rows count once per id; of several texts with one id the best window counts.
    """
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("string").alias("text"))
    found = None
    for index in _indexes(bench, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *x) for i, hits in zip(ids, shared.value.search(batch.column(1)))
                        for x in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
                        (pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                    ["id", "item", "similarity", "start_word"])

        part = texts.mapInArrow(run, "id long, item long, similarity double, start_word long")
        found = part if found is None else found.union(part)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("at"))).alias("best")
    return found.groupBy("id", "item").agg(best).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "best.similarity",
        (-F.col("best.at")).alias("start_word"))


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of the rows that hold no benchmark item; null and empty texts stay."""
    def free(index: Index) -> Column:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def without(texts: pa.Array) -> pa.Array:
            return pa.array([not hits for hits in shared.value.search(texts)], pa.bool_())

        return without(F.col(text_col).cast("string"))

    for index in _indexes(bench, item_col, item_text_col):
        docs = small_batches(docs).where(free(index))
    return docs
