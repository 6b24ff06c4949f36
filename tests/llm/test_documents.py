"""The operators on small tables: nulls, empty and long texts, ties, repeats, empty tables."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldstream.llm import (
    decontaminate,
    host_rules,
    language,
    line_dedup,
    packing,
    page_text,
    passages,
    set_join,
    token_file,
    toxicity,
)
from fieldstream.llm.components import components
from fieldstream.llm.queries import vocabulary

EDGE = [(1, None), (2, ""), (3, " \t\n"), (None, "one two"), (5, "12 34"), (5, "12 34"),
        (6, "word " * 30_000)]


def words(seed, n, stock=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(stock)}x{rng.randrange(stock)}" for _ in range(n)]


def test_page_text():
    page = ("<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav>"
            "<article><h1>Head</h1><p>First, long  paragraph &amp; more.<p>Second one, too.</p>"
            "</article><div class='comments'><p>Nice, really nice. I say so, yes.</p></div>"
            "<footer>c 2020</footer></body></html>")
    assert page_text.main_text(page)[0] == (
        "Head\nFirst, long paragraph & more.\nSecond one, too.")
    assert page_text.main_text(None) == ("", 0) and page_text.main_text("")[0] == ""
    assert page_text.main_text("<p>open <b>tags<p>and & signs <")[0].startswith("open tags")


def test_pages_with_nulls(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x</p>"), (None, "u", "<p>x</p>")],
                               "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in page_text.extract(df).collect())
    assert got == [(0, "x", 1), (0, "x", 1), (1, "", 0)]
    assert page_text.extract(df.limit(0)).count() == 0


def test_chunks_do_not_depend_on_neighbours():
    """The same texts in any batch, and shifts move only what is beside them."""
    texts = [" ".join(words(i, n)) for i, n in enumerate([0, 5, 12, 60, 400, 3000])]

    def of(some):
        raw, offsets = passages.K.text_bytes(pa.array(some, pa.string()))
        document, start, size, one, two = passages.chunks(raw, offsets)
        return [{(int(s), int(n), int(a), int(b)) for d, s, n, a, b in zip(
            document, start, size, one, two) if d == k} for k in range(len(some))]

    together = of(texts)
    assert [of([t])[0] for t in texts] == together and of(texts[::-1])[::-1] == together
    assert all(6 <= n <= 17 for x in together for _, n, _, _ in x)
    shifted = of(["one more " + texts[5]])[0]
    assert len({x[2:] for x in shifted} - {x[2:] for x in together[5]}) <= 4


def test_passages_against_brute_force(spark, make):
    """Every shared run of 51 words is found; nothing without a shared chunk is."""
    rows = [(i, " ".join(words(i, 40 + 7 * i, 3000))) for i in range(60)]
    shared = words(1001, 51, 3000)
    for i in (3, 17, 40):
        w = rows[i][1].split()
        rows[i] = (i, " ".join(w[:20] + shared + w[20:]).replace(" ", "\n" if i == 17 else " "))
    rows += [(100, rows[50][1]), (101, rows[50][1]), (102, " ".join(shared)), (103, None)]
    got = {}
    for r in passages.find(make(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    sets = {i: {tuple((t or "").split()[k:k + 6]) for k in range(len((t or "").split()) - 5)}
            for i, t in rows}
    held = {}
    for i, s in sets.items():
        for x in s:
            held.setdefault(x, set()).add(i)
    assert set(got) == {3, 17, 40, 50, 100, 101, 102}
    for i, found in got.items():
        w = dict(rows)[i].split()
        for r in found:
            part = w[r["start_word"]:r["start_word"] + r["n_words"]]
            assert all(len(held[tuple(part[k:k + 6])]) > 1 for k in range(len(part) - 5))
            assert r["n_removed"] == (0 if r["first_id"] == i else r["n_words"])
    texts = {r["doc_id"]: r["text"] for r in passages.drop_repeats(make(rows)).collect()}
    assert texts[3] == rows[3][1] and texts[50] == rows[50][1] and texts[103] is None
    assert len(texts[40].split()) == len(rows[40][1].split()) - got[40][0]["n_removed"]
    assert len(texts[101].split()) < 50


def test_passages_odd_rows(spark, make):
    long = " ".join(words(8, 30_000))
    rows = EDGE + [(7, long), (7, "x " + long), (8, long), (8, long), (6, EDGE[6][1] + long),
                   (9, EDGE[6][1])]
    got = {r["doc_id"]: r["n_removed"] for r in passages.find(make(rows)).collect()}
    assert set(got) == {6, 7, 8} and got[6] == 0 and 29_960 < got[8] <= 30_000
    assert passages.find(make(EDGE)).count() == 0
    assert passages.find(make(EDGE).limit(0)).count() == 0
    out = passages.drop_repeats(make(rows))
    assert out.count() == len(rows) and out.columns == make(rows).columns


def test_language(spark, make):
    stock = {"en": "the of and with this that", "de": "der die und nicht eine für",
             "fr": "le la des avec dans pour", "es": "el los las una por más"}
    rng = random.Random(1)
    rows = []
    for i in range(200):
        code = list(stock)[i % 4]
        rows.append((i, " ".join(rng.choices(stock[code].split(), k=30)), code, "s"))
    model = language.train(make(rows))
    assert model.families == ("germanic", "romance") and len(model.pairs) == 2
    got = language.identify(make(rows + [(900 + k, t) for k, t in EDGE if k]), model)
    answers = {r["doc_id"]: r for r in got.collect()}
    assert all(answers[r[0]]["lang_pred"] == r[2] for r in rows)
    assert all(answers[900 + k]["lang_pred"] == "und" and answers[900 + k]["score"] == 0
               for k in (1, 2, 3, 5))
    kept = language.recognised(make(rows + EDGE), model)
    assert kept.columns == make(rows).columns and kept.where("doc_id < 3").count() >= 1
    empty = language.train(make(rows).limit(0))
    assert language.identify(make(EDGE), empty).where("lang_pred <> 'und'").count() == 0


def test_toxicity(spark, make):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(i, 40, 30) + (["awful"] if bad else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    table = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(make(rows), table)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(make(rows), model).collect()}
    right = sum(got[i] == y for i, y in labels) / len(labels)
    assert right > 0.97 and 0 < len(model.cells) < 5000
    assert toxicity.score(make(EDGE), model).count() == len(EDGE)
    none = toxicity.train(make(rows), table.limit(0))
    assert toxicity.score(make(EDGE), none).agg(F.max("predicted")).first()[0] == 0


def test_host_rules(spark, make):
    good = [(i, " ".join(words(i, 30)), "en", "good") for i in range(20)]
    bad = [(100 + i, "### " * 40, "en", "bad") for i in range(20)]
    rows = good + bad + [(900 + (k or 99), t, "en", None) for k, t in EDGE] + [(300, "a b c d e f a b c d e f", "en", "good")]
    got = {r["doc_id"]: r for r in host_rules.judge(make(rows)).collect()}
    assert all(got[i]["kept"] for i in range(20)) and not any(got[100 + i]["kept"] for i in range(20))
    assert got[300]["n_repeat_words"] == 12 and got[300]["base_failed"]
    assert (got[901]["n_words"], got[902]["word_chars"], got[906]["n_words"]) == (0, 0, 30_000)
    assert host_rules.judge(make(rows).limit(0)).count() == 0


def test_line_dedup(spark, make):
    rows = [(i, f"Menu\n{' '.join(words(i, 8))}\n Menu ", "en", "a") for i in range(10)]
    rows += [(50 + i, "copied page\nall of it", "en", "a") for i in range(30)]
    rows += [(900 + (k or 99), t, "en", None) for k, t in EDGE]
    out = line_dedup.drop_boilerplate(make(rows))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["lines_dropped"] == 2 and got[3]["text"] == rows[3][1].split("\n")[1]
    assert got[55]["text"] == "copied page\nall of it" and got[901]["text"] is None
    assert out.count() == len(rows)
    assert line_dedup.drop_boilerplate(make(rows).limit(0)).count() == 0


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5
                   else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("size", [6, 12, 40, 150])
def test_set_join_against_brute_force(spark, make, size):
    """Chains of edits, a shared passage and a group above the hot-key limit."""
    rng = random.Random(size)
    base, passage = words(size, size), words(7, 30)
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, max(2, size // 12))):
            text[rng.randrange(len(text))] = f"e{i}"
        rows.append((i, " ".join(text)))
    text = words(99, size)
    for i in range(200, 230):  # a chain: neighbours link, far ends do not
        text[rng.randrange(len(text))] = f"c{i}"
        rows.append((i, " ".join(text)))
    rows += [(300 + i, " ".join(words(300 + i, 20) + passage)) for i in range(60)]
    rows += [(400, None), (401, ""), (402, rows[0][1].upper()), (403, "a b"), (404, "A b")]
    got = {r["doc_id"]: r["component_id"] for r in set_join.link(make(rows)).collect()}
    assert got == brute_components(rows)


def test_set_join_odd_rows(spark, make):
    got = set_join.link(make(EDGE)).collect()
    assert len(got) == len(EDGE)
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] != 6} == {
        (1, 1), (2, 2), (3, 3), (None, None), (5, 5)}
    assert set_join.link(make(EDGE).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}


def test_decontamination(spark, make):
    item = words(5, 30)
    near = list(item)
    near[1] = "other"
    rows = [(1, " ".join(words(1, 50) + item + words(2, 50))), (2, " ".join(words(3, 80))),
            (3, "###, ".join(words(4, 9) + near)), (4, " ".join(item[:15])), (10, "tiny"),
            (11, "tiny item here now")] + [(20 + (x[0] or 0), x[1]) for x in EDGE]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "Tiny item here now")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(make(rows), bench).collect()}
    assert got == {(1, 7), (3, 7), (11, 9)}
    kept = decontaminate.clean(make(rows), bench)
    assert kept.count() == len(rows) - 3 and kept.columns == make(rows).columns
    assert decontaminate.find(make(rows), bench.limit(0)).count() == 0
    assert decontaminate.find(make(rows).limit(0), bench).count() == 0


def test_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 3000)
    bins, offset = packing.best_fit(lengths)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 2048 and packing.lower_bound(lengths) <= len(fill)
    assert packing.lower_bound(np.array([1100, 1100, 1100])) == 3
    for b in range(3):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(offset[mine])]
        assert (offset[order] == np.cumsum(lengths[order]) - lengths[order]).all()


def truth(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary())
    coder.encode_special_tokens = True
    return [np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
            for t in texts]


TEXTS = EDGE + [(20 + i, t) for i, t in enumerate([
    "a  b", "a   b", " lead", "trail  ", "a\nb", "a\n\nb", "a \n b", "x  y", "it's, fine.",
    "<|endoftext|> x", "1 2 3,4 ...", "a\x0b b\x1c c"])]


def test_packing(spark, make):
    got = packing.pack(packing.cut(make(TEXTS), vocabulary()), pieces_a_part=4).toPandas()
    want = truth([t for _, t in TEXTS])
    assert got["length"].sum() == sum(map(len, want))
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group["offset"].to_numpy() == np.cumsum(group["length"]) - group["length"]).all()
        assert group["length"].sum() <= 2048
    long = want[6]
    for r in got[got["id"] == 6].itertuples():
        assert zlib.crc32(long[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack_documents(make(TEXTS).limit(0), vocabulary()).count() == 0


def test_token_file(spark, make):
    got = token_file.store_and_read(make(TEXTS), vocabulary()).collect()
    want = sorted((len(x), zlib.crc32(x.tobytes())) for x in truth([t for _, t in TEXTS]))
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    ends = np.cumsum([0] + [r["n_tokens"] for r in ordered])
    assert [r["start"] for r in ordered] == ends[:-1].tolist()
    ids = [r["doc_id"] for r in ordered]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_file.store_and_read(make(TEXTS).limit(0), vocabulary()).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 20_000), 5000).astype(np.int64)
    lengths = token_file.code_lengths(np.bincount(ids), 13)
    used = np.flatnonzero(lengths)
    assert lengths.max() <= 13 and (2.0 ** -lengths[used].astype(float)).sum() <= 1
    code = token_file.Code(used, lengths[used])
    count = np.array([1, 255, 256, 257, 20_000 - 769])
    block = token_file.write_block(code, ids, np.arange(5), count)
    back, docs, n = token_file.read_block(code, block)
    assert (back == ids).all() and (n == count).all() and (docs == np.arange(5)).all()


def test_pipeline_on_edge_rows(spark, make, tmp_path):
    import corpus_pipeline

    rows = [(i, " ".join(words(i % 15, 60)), "en", "s") for i in range(30)]
    rows += [(*x, "en", "s") for x in EDGE]
    make(rows).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words(3, 60)[5:30]))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got >= set(range(15)) - {3} and not got & ({3} | set(range(15, 30)))


def test_queries_have_their_names():
    from fieldstream.llm.queries import ORACLES, QUERIES

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and isinstance(pa.array([1]), pa.Array)
