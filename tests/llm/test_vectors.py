"""The vector operators against brute force, and on awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldstream.llm import hard_negatives, neighbours, whitening
from fieldstream.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
# Columns named like the operators' own.
LAYOUT = ("vec_id long, embedding array<float>, label int, id long, v string, first int, "
          "list int, pack int, score double, n int, component int, rank int")
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], LAYOUT)


@pytest.fixture(scope="module")
def crowded(spark):
    """Two clouds, 300 copies of one vector, a near-copy cloud, ties and unusable rows."""
    rng = np.random.default_rng(3)
    x = [*rng.standard_normal((300, 12)), *(rng.standard_normal((100, 12)) * .2 + 3)]
    x += [x[5]] * 300 + [x[6] + e for e in rng.standard_normal((200, 12)) * 1e-3]
    x += [np.sign(v) for v in rng.standard_normal((150, 12))]
    order = rng.permutation(len(x))
    rows = [(i, [float(np.float32(c)) for c in x[j]], int(rng.integers(0, 10)))
            for i, j in enumerate(order)]
    good = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    n = len(rows)
    rows += [(n, None, 1), (n + 100, [], 1), (n + 1, [1.0] * 11 + [None], 2),
             (n + 2, [NAN] * 12, 3), (n + 3, [INF] + [0.0] * 11, 3), (n + 4, [1.0] * 5, 4),
             (None, [0.5] * 12, 1), rows[7], rows[100]]
    return table(spark, rows), *good


def brute_nearest(x, k=10):
    out = {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:k]
        out[q] = [(r + 1, int(i), d[i]) for r, i in enumerate(best)]
    return out


def test_neighbours_on_crowded_rows(crowded):
    rows, x, _ = crowded
    got = neighbours.search(rows, F.col("vec_id") % 100 == 0).collect()
    want = brute_nearest(x)
    found = {q: sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
             for q in want}
    assert {r["query_id"] for r in got} == set(want)
    assert all([r for r, _, _ in v] == list(range(1, 11)) for v in found.values())
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q in want:
        for _, i, score in found[q]:
            assert score == pytest.approx(np.sqrt(((x[q] - x[i]) ** 2).sum()), rel=1e-12)


def test_neighbours_recall_on_the_shipped_table(spark):
    t = spark.read.parquet(SMALL + "/embeddings.parquet").toPandas().sort_values("vec_id")
    want = brute_nearest(np.stack(t.embedding).astype(float))
    got = QUERIES["op11_neighbours"](spark, SMALL).toPandas()
    hits = sum(len(set(got[got.query_id == q].vec_id) & {i for _, i, _ in v})
               for q, v in want.items())
    assert len(got) == 10 * len(want) and hits >= 0.9 * len(got)


def test_adaptive_scan_abandons_most_and_loses_few():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64)) * np.repeat([.05, 1.0], [40, 3960])[:, None]
    q = rng.standard_normal((8, 64)) * .05
    d = ((q[:, None] - x) ** 2).sum(2)
    limit = np.sort(d, axis=1)[:, 9]
    columns = [x[:, a:a + 16] for a in range(0, 64, 16)]
    a, r = neighbours.scan(q, limit, columns, 10)
    wanted = {(i, j) for i, j in zip(*np.nonzero(d <= limit[:, None]))}
    kept = set(zip(a.tolist(), r.tolist()))
    assert len(wanted & kept) >= 0.95 * len(wanted) and len(kept) < 10 * len(wanted)


def test_few_rows_and_none(spark):
    query = F.col("vec_id") % 100 == 0
    few = table(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.5], 1), (100, [1.0, 2.0], 2),
                        (200, [0.0, 0.0], 1)])
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"])
                 for r in neighbours.search(few, query).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.5)]
    none = few.where("vec_id < 0")
    assert neighbours.search(none, query).count() == 0
    assert hard_negatives.mine(none, query).count() == 0
    assert whitening.whiten(none).count() == 0
    equal = table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])
    assert whitening.whiten(equal).count() == 0  # nothing varies, so nothing can be whitened
    assert hard_negatives.mine(equal, F.lit(True)).count() == 0  # no other label


def brute_negatives(x, label):
    ids, y = np.arange(len(x)), np.floor(256 * x).astype(np.int64)
    out = set()
    for a in range(0, len(x), 100):
        s = y @ y[a]
        own = np.flatnonzero((label == label[a]) & (ids != a))
        for p in own[np.lexsort((own, -s[own]))][:5]:
            other = np.flatnonzero((label != label[a]) & (80 * s[p] <= 100 * s) & (s <= s[p]))
            for rank, n in enumerate(other[np.lexsort((other, -s[other]))][:5]):
                out.add((a, int(p), rank + 1, int(n), int(s[p]), int(s[n])))
    return out


FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_negatives_on_crowded_rows(crowded, monkeypatch):
    rows, x, label = crowded
    want = brute_negatives(x, label)
    query = F.col("vec_id") % 100 == 0
    assert len(want) > 100
    assert {tuple(r[f] for f in FIELDS) for r in hard_negatives.mine(rows, query).collect()} == want
    # Many small cells and blocks, so that visits stop early and are certified.
    for name, value in (("ROWS_A_CELL", 4), ("BLOCK_ROWS", 16), ("FIRST_ROWS", 20), ("PACK", 3),
                        ("ROWS_A_PART", 200)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert {tuple(r[f] for f in FIELDS) for r in hard_negatives.mine(rows, query).collect()} == want


def test_negatives_query(spark):
    t = spark.read.parquet(SMALL + "/embeddings.parquet").toPandas().sort_values("vec_id")
    label = np.where(t.vec_id % 7 == 0, (t.label + 1) % 10, t.label)
    got = QUERIES["op12_hard_negatives"](spark, SMALL).collect()
    assert ({tuple(r[f] for f in FIELDS) for r in got}
            == brute_negatives(np.stack(t.embedding).astype(float), label))


def test_heap_visits_every_cell_once_by_falling_bound():
    u, v = np.array([3.0, 9.0, 1.0]), np.array([0.5, 2.0, 2.0, -4.0])
    seen = list(hard_negatives.visit(u, v))
    assert len({(i, j) for _, i, j in seen}) == 12
    assert [b for b, _, _ in seen] == sorted((b for b, _, _ in seen), reverse=True)
    assert all(b == u[i] + v[j] for b, i, j in seen)


def test_scores_are_exact_beyond_doubles():
    a = np.array([[3 * 10 ** 7 + 1, 1]])
    assert hard_negatives.scores(a, a)[0, 0] == (3 * 10 ** 7 + 1) ** 2 + 1
    with pytest.raises(OverflowError):
        hard_negatives.scores(a * 10 ** 3, a)


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 40])
def test_scatter_is_exact(spread):
    rng = np.random.default_rng(spread)
    y = rng.integers(-spread, spread, (130, 5))
    s, c = whitening.block_scatter(y)
    z = y.astype(object)
    assert (s == z.sum(axis=0)).all()
    assert (np.triu(c) == np.triu(z.T @ z)).all()


def test_whitening_on_crowded_rows(crowded):
    rows, x, _ = crowded
    y = np.floor(64 * x).astype(np.int64) + 1_000_000
    fit = np.unique(np.concatenate([y, [[1_000_032] * 12]]), axis=0)  # the row without an id too
    n, total = len(fit), fit.sum(axis=0)
    spread = (fit - total / n).T @ (fit - total / n) / n
    value, vector = np.linalg.eigh(spread)
    value, vector = value[::-1], vector[:, ::-1]
    want = (y - total / n) @ vector / np.sqrt(value)
    out = whitening.whiten(rows).collect()
    assert len(out) == 12 * (len(x) + 3)
    got = {(r["vec_id"], r["component"]): r for r in out}
    for c in range(12):
        line = np.array([got[i, c + 1]["whitened"] for i in range(len(x))])
        sign = np.sign(line @ want[:, c])
        assert np.abs(sign * line - want[:, c]).max() < 1e-8
    for i in range(len(x)):
        assert int(got[i, 1]["deviation"]) == int(((n * y[i] - total) ** 2).sum())
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in out)
    assert got[0, 3]["explained"] == pytest.approx(value[2] / value.sum(), rel=1e-9)
