"""Passages that several documents share, by content-defined chunks.

A gear hash rolls over the bytes of a text but for its white space (it depends on the last
GEAR of them alone). A word
is a cut when its end has the least hash of some WINDOW neighbouring words, so cuts follow
from the text around them and lie at most WINDOW words apart: an insertion moves only the
cuts beside it. From each cut a chunk runs to the first cut at least ``LEAST_CHUNK`` words
on; chunks overlap, since a least size that counted from the chunk before would tie every
cut to the start of the text. Chunks are compared by a 128-bit digest of their words.

A digest that at least two documents hold is repeated, and touching repeated chunks make a
passage. Of a shared run of n words whose first GEAR bytes hold s words, at least
``n - s - 2 * (WINDOW - 1) - LEAST_CHUNK`` are covered. A run of 51 words is thus seen unless
its first GEAR bytes hold more than 5 words; runs of such short words may be missed, because
a passage needs LEAST_WORDS covered words. Words are ``[^\\x20\\x09-\\x0D]+``; case counts, the kind and amount of white space does not. A chunk of
one word over and over tells nothing about where a text comes from and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import BROADCAST_ROWS, keep

U64 = np.uint64
GEAR = 16
WINDOW = 12
LEAST_CHUNK = 6
#: A passage has at least so many words in repeated chunks.
LEAST_WORDS = 18

_TABLE = np.concatenate([np.zeros(1, U64), K.mix(np.arange(1, 257, dtype=U64))])
_PLACE = U64((1 << 24) - 1)


def gear(raw: np.ndarray, offsets: np.ndarray, at: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Gear hash up to each place ``at`` (inclusive), within its document; space left out."""
    inside = ~K.SPACE[raw]
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside)])
    gap = np.arange(1, len(offsets)) * GEAR
    padded = np.zeros(int(before[-1]) + GEAR * len(offsets), U64)
    padded[np.arange(int(before[-1])) + np.repeat(gap, np.diff(before[offsets]))] = _TABLE[
        raw[inside].astype(np.int64) + 1]
    width = 1
    while width < GEAR:
        padded[width:] = padded[width:] + (padded[:-width] << U64(width))
        width *= 2
    return K.mix(padded[before[at] + gap[document]])


def cuts(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words with the least value of some WINDOW words of one document (the last, if tied)."""
    if len(values) < WINDOW:
        return np.zeros(0, np.int64)
    place = np.arange(len(values), dtype=np.int64)
    least = (values & ~_PLACE) | (_PLACE - (place.astype(U64) & _PLACE))
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[:width - WINDOW], least[WINDOW - width:])
    start = place[:len(least)]
    found = start + ((_PLACE - (least & _PLACE)).astype(np.int64) - start & int(_PLACE))
    edge = first[np.searchsorted(first, start, "right")]
    return np.unique(found[start + WINDOW <= edge])


def digests(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the words from start to end (2 x chunks)."""
    up, down = K._POWERS.upto(len(hashes) + 1)
    out = np.empty((2, len(start)), U64)
    for k, words in enumerate((hashes, K.mix(hashes ^ U64(0xA0761D6478BD642F)))):
        sums = np.zeros(len(words) + 1, U64)
        np.cumsum(words * up[:len(words)], out=sums[1:])
        out[k] = K.mix((sums[end] - sums[start]) * down[start])
    return out


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first word, words, digest, digest) of the chunks of some texts."""
    words = K.Words(raw, offsets)
    document = words.document()
    if not len(words):
        return *(np.zeros(0, np.int64) for _ in range(3)), *np.zeros((2, 0), U64)
    cut = cuts(gear(raw, offsets, words.end - 1, document), words.first)
    to = np.searchsorted(cut, cut + LEAST_CHUNK)
    cut, to = cut[to < len(cut)], cut[to[to < len(cut)]]
    hashes = words.hashes()
    changes = np.concatenate([np.zeros(1, np.int64), np.cumsum(hashes[1:] != hashes[:-1])])
    fit = (document[cut] == document[to]) & (changes[to] > changes[np.minimum(cut + 1, to)])
    cut, to = cut[fit], to[fit]
    return (document[cut], cut + 1 - words.first[document[cut]], to - cut,
            *digests(hashes, cut + 1, to + 1))


def _occurrences(texts: DataFrame) -> DataFrame:
    """(id, version, d1, d2, start, words): the chunks of (id, version, text) rows."""
    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            raw, offsets = K.text_bytes(batch.column(2))
            for a, b in K.runs(offsets):
                document, start, size, one, two = chunks(
                    raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][document], pa.int64()),
                     pa.array(versions[a:b][document], pa.int64()),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                    ["id", "version", "d1", "d2", "start", "words"])

    return texts.mapInArrow(run, "id long, version long, d1 long, d2 long, start int, words int")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         least_words: int = LEAST_WORDS) -> DataFrame:
    """(id_col, version, start_word, n_words, first_id, n_removed, removed) of each passage.

    ``first_id`` is the least id that holds a chunk of the passage; ``removed`` are the
    (first word, end) ranges that an earlier id has too, of ``n_removed`` words together.
    ``version`` is a hash of the text: equal rows are one document, several texts of one id
    are listed apart and do not repeat each other. Rows without an id or a text, and texts
    without a cut, have no passage; an empty table gives an empty result.
    """
    texts = (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
             .select(F.col(id_col).cast("long").alias("id"),
                     F.xxhash64(F.col(text_col).cast("string")).alias("version"),
                     F.col(text_col).cast("string").alias("text")))
    seen = _occurrences(texts)
    key = ["d1", "d2"]
    repeated = keep(
        seen.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last"),
                               F.count("*").alias("n"))
        .where(F.col("first") < F.col("last")).drop("last"), "chunks")
    # Digests with more than a fixed share of these rows are fewer than BROADCAST_ROWS; the
    # others have too few rows to make a task long.
    total = repeated.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * BROADCAST_ROWS > F.lit(total)
    hot = F.broadcast(repeated.where(often).drop("n"))
    known = seen.join(hot, key, "left")
    found = (known.where(F.col("first").isNotNull())
             .unionByName(known.where(F.col("first").isNull()).drop("first")
                          .join(repeated.where(~often).drop("n"), key)))
    later = F.col("first") < F.col("id")
    end = F.col("start") + F.col("words")
    text = Window.partitionBy("id", "version").orderBy("start", "end")
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    touched = (
        found.select("id", "version", "start", end.alias("end"), "first",
                     F.when(later, end).alias("gone"))
        .withColumn("reach", F.max("end").over(before))
        .withColumn("gone_to", F.coalesce(F.max("gone").over(before), F.lit(0)))
        .withColumn("fresh", F.greatest(F.lit(0), F.col("gone") - F.greatest("start", "gone_to")))
        .withColumn("passage", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1))
                    .over(text.rowsBetween(Window.unboundedPreceding, 0))))
    size = F.col("upto") - F.col("start_word")
    return (
        touched.groupBy("id", "version", "passage")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("upto"),
             F.min("first").alias("first_id"), F.sum("fresh").alias("n_removed"),
             F.collect_list(F.when(F.col("fresh") > 0, F.struct(
                 F.greatest("start", "gone_to").alias("start"), F.col("gone").alias("end"))))
             .alias("removed"))
        .where(size >= least_words)
        .select(F.col("id").alias(id_col), "version", F.col("start_word").cast("long"),
                size.cast("long").alias("n_words"), "first_id",
                F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                F.array_sort("removed").alias("removed")))


def _without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges and the white space after them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = K.Words(raw, np.array([0, len(raw)]))
    begin = np.append(words.start, len(raw))
    kept, at = [], 0
    for a, b in sorted(ranges):
        kept.append(raw[at:max(at, int(begin[a]))].tobytes())
        at = max(at, int(begin[b]))
    return b"".join([*kept, raw[at:].tobytes()]).decode()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with each shared passage left only in the document of the least id.

    Rows and columns stay; texts without a passage, null texts and rows without an id are
    unchanged, and repeated rows are treated alike.
    """
    cut = (find(docs, id_col, text_col, least_words).where(F.col("n_removed") > 0)
           .groupBy(F.col(id_col).alias("__id"), F.col("version").alias("__version"))
           .agg(F.flatten(F.collect_list("removed")).alias("__removed")))

    @F.arrow_udf("string")
    def without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([t if not r else _without(t, [(x["start"], x["end"]) for x in r])
                         for t, r in zip(texts.to_pylist(), ranges.to_pylist())], pa.string())

    text = F.col(text_col).cast("string")
    joined = docs.join(cut, (F.col(id_col).cast("long") == F.col("__id"))
                       & (F.xxhash64(text) == F.col("__version")), "left")
    return joined.withColumn(text_col, without(text, F.col("__removed"))).select(*docs.columns)
