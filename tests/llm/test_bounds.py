"""Bounded slices and caches, letters of any script, and scoring of empty tables."""

import numpy as np
import pyarrow as pa
import pytest

from fieldstream.llm import kernels as K
from fieldstream.llm import language, tokens, toxicity
from fieldstream.llm.common import ARROW_BYTES, small_batches
from fieldstream.llm.components import components, forest


def test_slices_cut_before_any_copy():
    texts = pa.array(["a" * 10, None, "", "b" * 100, "cc"])
    got = [(first, some.to_pylist()) for first, some in K.slices(texts, 12)]
    assert got == [(0, ["a" * 10, None, ""]), (3, ["b" * 100]), (4, ["cc"])]
    assert list(K.slices(pa.array([], pa.string()))) == []
    assert [first for first, _ in K.slices(pa.chunked_array([["x"], ["y"]]), 1)] == [0, 1]


def test_signs_of_any_script_do_not_hide_a_word():
    def cells(text):
        return set(next(iter(toxicity._features(pa.array([text]), 20))).tolist())

    bare = cells("you idiot now")
    assert bare == cells("“you” — idiot… now") == cells("YOU IDIOT NOW")
    assert cells("ÉTÉ") == cells("été")
    assert cells("") == cells("— … 12") == set()


@pytest.mark.parametrize("budget", [0, 2000, 1 << 20])
def test_a_full_cache_changes_no_ids(monkeypatch, budget):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "CACHE_BYTES", budget)
    encoder = tokens.Encoder(path, True)
    rng = np.random.default_rng(0)
    texts = [" ".join("".join(rng.choice(list("abcdeé,."), 6)) for _ in range(40))
             for _ in range(30)] * 2
    got = [ids[at[k]:at[k + 1]].tolist()
           for _, ids, at in encoder.slices(pa.array(texts), 2000) for k in range(len(at) - 1)]
    assert got == [encoder.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    held = sum(p.known.nbytes + p.ids.nbytes + p.at.nbytes for p in (encoder.spaced, encoder.bare))
    assert held <= 2 * budget + 4096


def test_batches_are_bounded_but_never_raised(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for value, after in (("64m", str(ARROW_BYTES)), (str(ARROW_BYTES), str(ARROW_BYTES)),
                             ("1000", "1000")):
            spark.conf.set(name, value)
            small_batches(spark.range(1))
            assert spark.conf.get(name).removesuffix("b") == after
    finally:
        spark.conf.set(name, before)


def test_language_and_toxicity_of_empty_tables(spark, make):
    docs = make([(i, f"the cat sat on the mat number {i}" if i % 2 else f"die katze auf der matte {i}",
                  "en" if i % 2 else "de", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    none = docs.where("doc_id < 0")
    for model in (language.train(docs), language.train(none)):
        assert language.identify(none, model).count() == 0
        assert language.identify(docs, model).count() == 40
    for model in (toxicity.train(docs, labels), toxicity.train(none, labels)):
        assert toxicity.score(none, model).count() == 0
        assert toxicity.score(docs, model).count() == 40


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_a_forest_joins_what_its_links_join():
    rng = np.random.default_rng(4)
    u, v = rng.integers(-50, 50, (2, 60))
    node, root = forest(u, v, 3)
    want = union_find(zip(u.tolist(), v.tolist()))
    groups = {}
    for n, r in zip(node.tolist(), root.tolist()):
        groups.setdefault(r, set()).add(want.get(n, n))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(
        {want.get(n, n) for n in node.tolist()})


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(400)],                                  # a chain
    [(9, i) for i in range(300)] + [(9, 9), (None, 3), (-4, 700)],     # a hub
    []])
def test_components_over_many_partitions(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == union_find(links)
