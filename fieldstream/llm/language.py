"""Language identification in two levels: the family first, then its members.

Letters of a text by their Unicode class (other runs become one space) give hashed byte 3-grams. A linear
support vector machine per family picks the family; inside it one machine per pair of
languages votes. Training takes a bounded sample (``train_per_language`` texts of each
label) to the driver as sparse counts; prediction runs over all texts in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstream.llm import kernels as K
from fieldstream.llm.common import bounded_sample, small_batches

UNDETERMINED = "und"
#: Language codes by family; a code of no family is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "sk", "cs", "pl", "mk"),
    "indic": ("hi", "bn", "mr", "gu", "pa", "ne", "ur", "sa"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "uralic": ("fi", "et", "hu"),
    "semitic": ("ar", "he", "mt", "am"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram; the last row of each matrix is the bias."""

    dims: int
    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int, int], ...]  # family, member, member
    family_weights: np.ndarray               # dims + 1, families
    pair_weights: np.ndarray                 # dims + 1, pairs


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one space for every other run; each text starts with one."""
    gap = K.NOT_LETTER[raw]
    kept = ~gap
    kept[1:] |= ~gap[:-1]  # the first other byte after a letter
    first = offsets[:-1][offsets[:-1] < len(raw)]
    kept[first] = ~gap[first]
    low = K.LOWER[raw]
    low[gap] = 0x20
    before = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(kept, out=before[1:])
    at = before[offsets]
    n = len(offsets) - 1
    out = np.full(int(at[-1]) + n, 0x20, dtype=np.uint8)
    chosen = low[kept]
    out[np.arange(len(chosen)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = chosen
    return out, at + np.arange(n + 1)


def _features(column: pa.Array, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of texts: counts (texts x dims, unit length of their roots), has a letter."""
    # At most 128 texts at once bound the dense table; longer runs follow the text's bytes.
    for _, some in K.slices(column):
        raw, offsets = K.text_bytes(K.blank(some, K.NO_LETTERS))
        for a in range(0, len(some), 128):
            b = min(a + 128, len(some))
            text, at = _letters(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            wide = text.astype(np.uint32)
            gram = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            cell = ((gram * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(dims)
            n, length = b - a, np.diff(at)
            owner = np.repeat(np.arange(n), length)[:len(gram)]
            inside = np.arange(len(gram)) + 3 <= at[1:][owner]
            counts = np.bincount(owner[inside] * dims + cell[inside].astype(np.int64),
                                 minlength=n * dims).reshape(n, dims)
            x = np.sqrt(counts.astype(np.float32))
            x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)
            yield x, length > 1


def _svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 80) -> np.ndarray:
    """Squared-hinge linear machine; balanced classes, plain accelerated gradient steps."""
    n, d = x.shape
    weight = np.where(y > 0, n / (2.0 * max(1, (y > 0).sum())),
                      n / (2.0 * max(1, (y < 0).sum()))).astype(np.float32)
    w = np.zeros(d, dtype=np.float32)
    ahead, momentum = w.copy(), 1.0
    step = 1.0 / (1.0 + 2.0 * c * float((weight * (x * x).sum(axis=1)).max()))
    for _ in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        slope = ahead / n - (2.0 * c / n) * ((weight * y * slack) @ x)
        fresh = ahead - step * slope
        after = (1.0 + math.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
        ahead = fresh + ((momentum - 1.0) / after) * (fresh - w)
        w, momentum = fresh, after
    return w


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", train_per_language: int = 800, dims: int = 4096) -> Model:
    """Fit on about ``train_per_language`` texts of each non-null label.

    Rows without a label or without a letter teach nothing. Without any label the model
    has no language and predicts ``und`` alone.
    """
    rows = (labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                           & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    F.col(lang_col).alias("lang")))
    sample = bounded_sample(rows, "id", "lang", train_per_language).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at = batch.column(0), 0
            for x, lettered in _features(batch.column(1), dims):
                cells, values = [], []
                for row in x:
                    hit = np.flatnonzero(row)
                    cells.append(hit.astype(np.uint16).tobytes())
                    values.append(row[hit].astype(np.float16).tobytes())
                out = pa.RecordBatch.from_arrays(
                    [langs.slice(at, len(x)), pa.array(cells, pa.binary()),
                     pa.array(values, pa.binary())], ["lang", "cells", "values"])
                yield out.filter(pa.array(lettered))
                at += len(x)

    found = sample.mapInArrow(K.tidy(sparse), "lang string, cells binary, values binary").toArrow()
    langs = found["lang"].to_pylist()
    order = sorted(range(len(langs)), key=lambda i: (langs[i], found["cells"][i].as_py()))
    x = np.zeros((len(langs), dims + 1), dtype=np.float32)
    x[:, dims] = 0.1
    for row, i in enumerate(order):
        x[row, np.frombuffer(found["cells"][i].as_py(), np.uint16)] = np.frombuffer(
            found["values"][i].as_py(), np.float16)
    label = np.array([langs[i] for i in order], dtype=object)
    codes = sorted(set(langs))
    families = tuple(sorted({FAMILY_OF.get(code, code) for code in codes}))
    members = tuple(tuple(c for c in codes if FAMILY_OF.get(c, c) == f) for f in families)
    kin = np.array([families.index(FAMILY_OF.get(code, code)) for code in label], dtype=np.int64)
    family_weights = np.zeros((dims + 1, len(families)), dtype=np.float32)
    if len(families) > 1:
        for k in range(len(families)):
            family_weights[:, k] = _svm(x, np.where(kin == k, 1, -1).astype(np.float32))
    pairs, columns = [], []
    for k, own in enumerate(members):
        for a, b in combinations(range(len(own)), 2):
            rows_of = np.flatnonzero((label == own[a]) | (label == own[b]))
            y = np.where(label[rows_of] == own[a], 1, -1).astype(np.float32)
            pairs.append((k, a, b))
            columns.append(_svm(x[rows_of], y))
    pair_weights = (np.stack(columns, axis=1) if columns
                    else np.zeros((dims + 1, 0), dtype=np.float32))
    family_weights[dims] *= 0.1
    pair_weights[dims] *= 0.1
    return Model(dims, families, members, tuple(pairs), family_weights, pair_weights)


def _decide(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and confidence of each row of features."""
    def sure(margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-4.0 * np.clip(margin, -10, 10)))

    n = len(x)
    by_family = x @ model.family_weights[:-1] + model.family_weights[-1]
    by_pair = x @ model.pair_weights[:-1] + model.pair_weights[-1]
    family = by_family.argmax(axis=1)
    score = sure(by_family[np.arange(n), family]) if len(model.families) > 1 else np.ones(n)
    lang = np.empty(n, dtype=object)
    for k, own in enumerate(model.members):
        mine = np.flatnonzero(family == k)
        votes = np.zeros((len(mine), len(own)))
        weakest = np.full((len(mine), len(own)), np.inf)
        for column, (of, a, b) in enumerate(model.pairs):
            if of == k:
                margin = by_pair[mine, column]
                # The margin breaks ties of votes and never outweighs one.
                votes[:, a] += (margin >= 0) + 0.01 * np.tanh(margin)
                votes[:, b] += (margin < 0) - 0.01 * np.tanh(margin)
                weakest[:, a] = np.minimum(weakest[:, a], margin)
                weakest[:, b] = np.minimum(weakest[:, b], -margin)
        best = votes.argmax(axis=1)
        lang[mine] = np.array(own, dtype=object)[best]
        if len(own) > 1:
            score[mine] *= sure(weakest[np.arange(len(mine)), best])
    return lang, score


def predict_column(df: DataFrame, model: Model, text: str) -> Column:
    """A struct (lang_pred, score) of a text column."""
    shared = small_batches(df).sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()),
                         T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        held = shared.value
        langs, scores = [np.zeros(0, object)], [np.zeros(0)]
        for x, lettered in _features(texts, held.dims):
            if held.families:
                lang, score = _decide(held, x)
            else:
                lang, score = np.full(len(x), UNDETERMINED, object), np.zeros(len(x))
                lettered = np.zeros(len(x), dtype=bool)
            langs.append(np.where(lettered, lang, UNDETERMINED))
            scores.append(np.where(lettered, score, 0.0))
        K.release()
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(langs).tolist(), pa.string()),
             pa.array(np.concatenate(scores).astype(np.float64), pa.float64())],
            ["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every row.

    A null text, an empty one and one without a letter give ``und`` with score 0. Repeated
    rows are answered alike; a null id is kept; other columns are not read.
    """
    answer = predict_column(docs, model, text_col)
    return (docs.select(F.col(id_col), answer.alias("__answer"))
            .select(id_col, "__answer.lang_pred", "__answer.score"))


def recognised(docs: DataFrame, model: Model, least_score: float = 0.25,
               text_col: str = "text") -> DataFrame:
    """All columns of the rows whose language is recognised with some confidence."""
    answer = predict_column(docs, model, text_col)
    name = "__answer"
    return (docs.withColumn(name, answer)
            .where((F.col(f"{name}.lang_pred") != UNDETERMINED)
                   & (F.col(f"{name}.score") >= least_score)).drop(name))
