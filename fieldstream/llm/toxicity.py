"""Toxicity scores by FTRL-proximal logistic regression.

A text's features are its distinct words, word pairs and skip-pairs (one word between),
hashed to ``2**bits`` cells; words are runs of letters (by Unicode class),
lower-cased. Training goes over a
bounded sample of labelled rows with one learning rate per coordinate and an L1 term, so
few weights are not zero; only those are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import bounded_sample

THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    bits: int
    cells: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def _features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct feature cells of each text."""
    for _, some in K.slices(column):
        # Signs of any script end a word, and letters of any script lose their case.
        raw, offsets = K.text_bytes(pc.utf8_lower(K.blank(some, K.NO_LETTERS)))
        words = K.Words(raw, offsets, K.NOT_LETTER)
        single = words.hashes()
        pair = np.zeros(len(single), dtype=K.U64)
        skip = np.zeros(len(single), dtype=K.U64)
        pair[1:] = K.mix(single[:-1] * K.U64(3) + single[1:])
        skip[2:] = K.mix(single[:-2] * K.U64(5) + single[2:])
        cut = K.U64(64 - bits)
        cells = [(x >> cut).astype(np.uint32) for x in (single, pair, skip)]
        for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield np.unique(np.concatenate([cells[0][i:j], cells[1][i + 1:j], cells[2][i + 2:j]]))


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 12.0, l2: float = 1.0,
         epochs: int = 4) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal updates over the examples, in the order given.

    State per cell: z (shifted sum of gradients) and n (sum of their squares); the weight
    is zero while ``|z| <= l1``. The bias is a cell of its own without the L1 term.
    """
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        held = z[at]
        return np.where(np.abs(held) <= l1, 0.0,
                        (np.sign(held) * l1 - held) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for cells, label in zip(examples, labels):
            w = weights(cells)
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - label
            rate = (np.sqrt(n[cells] + g * g) - np.sqrt(n[cells])) / alpha
            z[cells] += g - rate * w
            n[cells] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    all_cells = np.arange(1 << bits)
    return weights(all_cells), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2))


def _scale(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that bring the logits to probabilities (Newton steps, few rounds).

    A prior of ``pull`` keeps both near 1 and 0 where the examples are few or separable.
    """
    a, b, pull = 1.0, 0.0, 5.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * logit + b, -35, 35)))
        g = np.array([((p - label) * logit).sum() + pull * (a - 1.0),
                      (p - label).sum() + pull * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * logit * logit).sum() + pull, (q * logit).sum()],
                      [(q * logit).sum(), q.sum() + pull]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(np.clip(a, 0.1, 10.0)), float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_rows: int = 6000, bits: int = 18,
          **ftrl_options) -> Model:
    """Fit on about ``train_rows`` labelled rows (half of them for each label at most).

    Labels other than 0 and 1, null labels and null texts teach nothing; several labels of
    one id count as their largest. Without examples every score is 0.
    """
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")))
    chosen = bounded_sample(known, "id", "label", train_rows // 2)
    rows = chosen.count()
    texts = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small = F.broadcast(chosen) if rows <= 2 * train_rows else chosen

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [x.tobytes() for x in _features(batch.column(2), bits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.binary())],
                ["id", "label", "cells"])

    found = (texts.join(small, "id").select("id", F.col("label").cast("int"), "text")
             .mapInArrow(sparse, "id long, label int, cells binary").toArrow())
    ids, y = found["id"].to_numpy(), found["label"].to_numpy().astype(np.float64)
    cells = [np.frombuffer(x, np.uint32) for x in found["cells"].to_pylist()]
    # A fixed order that mixes the labels: by a hash of the id, then by content.
    rank = K.mix(ids.astype(np.int64).view(K.U64))
    order = sorted(range(len(ids)), key=lambda i: (rank[i], len(cells[i])))
    if not order:
        return Model(bits, np.zeros(0, np.uint32), np.zeros(0), -35.0, 1.0, 0.0)
    examples, y = [cells[i] for i in order], y[order]
    dense, bias = ftrl(examples, y, bits, **ftrl_options)
    logit = np.array([dense[x].sum() + bias for x in examples])
    slope, shift = _scale(logit, y)
    hit = np.flatnonzero(dense)
    return Model(bits, hit.astype(np.uint32), dense[hit], bias, slope, shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every row.

    A null or empty text has no features and gets the score of the bias. Repeated rows are
    answered alike; a null id is kept; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        held = shared.value
        dense = np.zeros(1 << held.bits)
        dense[held.cells] = held.weights
        logit = np.fromiter((dense[x].sum() for x in _features(texts, held.bits)), np.float64,
                            len(texts)) + held.bias
        K.release()
        p = 1.0 / (1.0 + np.exp(-np.clip(held.slope * logit + held.shift, -35, 35)))
        return pa.array(p, pa.float64())

    return (docs.select(F.col(id_col), probability(F.col(text_col).cast("string")).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
