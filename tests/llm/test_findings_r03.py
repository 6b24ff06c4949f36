"""Tests of the findings of round 3 about the training-data operators."""

import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from fieldstream.llm import near_pages, set_join, token_file, tokens
from fieldstream.llm.queries import vocabulary


def test_line_dedup_stage_runs_no_python(spark, make, monkeypatch):
    """40 pages with a menu line, 6 of them near copies, which count once."""
    import corpus_pipeline

    article = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(12)]
    rows = []
    for i in range(40):
        body = [" ".join(f"p{i}y{j}" for j in range(9)), f"the other line of page {i}"]
        if i < 6:
            body = [*article[:i], article[i] + f" edit{i}", *article[i + 1:]]
        rows.append((i, "\n".join(["Menu of the site", *body]), "en", "a"))
    docs = make(rows)

    def python(*_, **__):
        raise AssertionError("runs Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, python)
    for name in ("applyInArrow", "applyInPandas"):
        monkeypatch.setattr(type(docs.groupBy("doc_id")), name, python)
    got = {r["doc_id"]: r["text"]
           for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}
    assert got == {i: t.split("\n", 1)[1] for i, t, *_ in rows}


@pytest.mark.parametrize("pairs_a_row", [16, 0])
def test_near_pages_links_as_the_set_join(make, monkeypatch, pairs_a_row):
    """Drifting copies (chains), pages that are only just alike or not, short and empty ones."""
    rng = np.random.default_rng(3)
    texts = ["", " \n", "one", "ONE", "one two three", "a b c d e", "A\tb\x0bc d  e", "a b c d f",
             " ".join("abcdefgh"), " ".join("abcdefghi"), "\u00c9t\u00e9", "\u00e9t\u00e9",
             "a\u00a0b", "a b"]
    menu = [f"m{j}" for j in range(60)]
    for size in (8, 9, 24, 40, 90, 400):
        base = [f"s{size}b{j}" for j in range(size)]
        for step in range(1, 6):
            words = list(base)
            for k in range(14):
                texts.append(" ".join(words))
                for at in rng.integers(0, len(words), max(1, step * size // 200)):
                    words[at] = f"s{size}t{step}k{k}"
                if k % 5 == 4:
                    words = words[:-1] if rng.random() < 0.5 else [*words, f"more{k}"]
    texts += [" ".join([*menu, *(f"c{i}x{j}" for j in range(4 + i % 12))]) for i in range(60)]
    texts = list(dict.fromkeys(texts))
    ids = rng.permutation(len(texts)).tolist()
    docs = make(list(zip(ids, texts)))
    monkeypatch.setattr(near_pages, "PAIRS_A_ROW", pairs_a_row)
    got = {r["doc_id"]: r["component_id"] for r in near_pages.link(docs).collect()}
    assert got == {r["doc_id"]: r["component_id"] for r in set_join.link(docs).collect()}
    assert 10 < len(set(got.values())) < len(got)
    assert near_pages.link(docs.limit(0)).count() == 0


def test_words_of_letters_skip_the_pre_tokenizer(monkeypatch):
    """They are most of what is encoded; every range of letters gives the plain ids."""
    from tokenizers import Tokenizer

    spans = [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x17F),
             (0x391, 0x3A1), (0x3A3, 0x3C9), (0x400, 0x481)]
    letters = "".join(chr(x) for a, b in spans for x in range(a, b + 1))
    assert all(unicodedata.category(x).startswith("L") for x in letters)
    shown = [letters[i:i + n] for n in (1, 2, 5, 11) for i in range(len(letters) - n + 1)]
    mixed = ["it's", "don't", "a1b2", "x́y", "中文", "ªµ", "$$$", "A$$$",
             "a­b", "﻿z", "Ġx", "Ċ", "1½", "\U0001f600", "a,b.", "...", "א"]
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):
        picked = [shown[i] for i in rng.integers(0, len(shown), 80)]
        for i in rng.integers(0, 80, 12):
            picked[i] = mixed[rng.integers(0, len(mixed))] + rng.choice(["", ",", "."])
        texts.append(" ".join(picked[:40]) + "\n" + " ".join(picked[40:]))
    slow = []
    whole = tokens.Pieces._any

    def watched(self, pieces):
        slow.extend(self.before + x for x in pieces.to_pylist())
        return whole(self, pieces)

    monkeypatch.setattr(tokens.Pieces, "_any", watched, raising=False)
    plain = Tokenizer.from_file(vocabulary())
    ids, at = tokens.Encoder(vocabulary(), True).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert slow and not any(x[0] == " " and set(x[1:]) <= set(letters) for x in slow if x)


def byte_level(merges, added=()):
    """A tokenizer of single bytes and these merges."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, pre_tokenizers

    names = ["<end>", *sorted(pre_tokenizers.ByteLevel.alphabet()), *(a + b for a, b in merges)]
    made = Tokenizer(models.BPE({x: i for i, x in enumerate(names)}, merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.decoder = decoders.ByteLevel()
    made.add_special_tokens([AddedToken(x, special=True) for x in added])
    return made


def test_letters_with_signs_behind_them_are_two_pieces(monkeypatch):
    """Only the letters are looked up and encoded as a word; the signs' ids follow them."""
    from string import punctuation

    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    signs = [*punctuation, "$$$", "...", ".***", ",###", "'", "''", "\").", "!" * 16, "!" * 17,
             "$" * 4000, "<|", "|>"]
    words = ["Thnder", "straße", "слово", "中文", "x", "it"]
    odd = ["it's,", "'s", "'s.", "a1$", "1$$$", "x́$", "a.b.", "$x$", "²$", "a….",
           "é $", "...", "$", "Ⅷ$"]
    pieces = [w + s for w in words for s in signs] + odd + words
    texts = [" ".join(pieces[i] for i in rng.permutation(len(pieces))) for _ in range(3)]
    texts += ["\n".join(pieces), " ".join(pieces).replace(" $", "\t$"), *pieces]
    slow = []
    whole = tokens.Pieces._any

    def watched(self, some):
        slow.extend(self.before + x for x in some.to_pylist())
        return whole(self, some)

    monkeypatch.setattr(tokens.Pieces, "_any", watched)
    plain = Tokenizer.from_file(vocabulary())
    ids, at = tokens.Encoder(vocabulary(), True).encode(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not {x for x in slow if x.startswith((" Thnder", " stra", " x$", " it$"))
                and len(x) < 20}


def test_signs_that_are_a_special_token_are_ordinary_text_without_added_tokens(tmp_path):
    path = str(tmp_path / "made.json")
    byte_level([("$", "$")], ["$$$"]).save(path)
    texts = ["ab$$$ cd$$ $$$", "ab$$$", "x ab$$$, y"]
    for added in (True, False):
        encoder = tokens.Encoder(path, added)
        ids, at = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[at[i]:at[i + 1]].tolist() == want


def test_words_are_run_together_only_where_no_merge_joins_them(tmp_path):
    """The model gets many words as one piece; a merge over a space needs the long way."""
    space = tokens.ALPHABET[32]
    texts = ["ab ab ba b ab", "abb abab b\nab ab"]
    for merges, together in (([(space, "a"), ("a", "b"), (space, "b")], True),
                             ([("b", space), ("a", "b")], False),
                             ([(tokens.ALPHABET[0xC2], tokens.ALPHABET[0xA0]),
                               (tokens.ALPHABET[0xC2] + tokens.ALPHABET[0xA0], space),
                               (space, "a")], True)):
        path = str(tmp_path / f"{len(merges)}{together}.json")
        byte_level(merges).save(path)
        encoder = tokens.Encoder(path, True)
        words = encoder.spaced.words
        assert (words is not None) == together
        if together:
            assert words.tokenizer.pre_tokenizer is None
        ids, at = encoder.encode(pa.array(texts, pa.large_string()))
        for i, text in enumerate(texts):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[at[i]:at[i + 1]].tolist() == want


@pytest.mark.parametrize("symbols, length_bits", [(1, 5), (2, 5), (3, 5), (300, 5), (60_000, 5),
                                                  (300, 25)])
def test_blocks_hold_the_code_words_bit_by_bit(symbols, length_bits, monkeypatch):
    """Short and long words, documents of one to many runs; ids with no room in 32 bits."""
    monkeypatch.setattr(token_file, "LENGTH_BITS", length_bits, raising=False)
    rng = np.random.default_rng(symbols)
    count = np.array([1, 2, 255, 256, 257, 40, 1, 3000, 513, 31, 32, 33, 1])
    ids = rng.zipf(1.3, int(count.sum())) % symbols
    lengths = token_file.code_lengths(np.bincount(ids, minlength=symbols) + 1)
    code = token_file.Code(np.arange(symbols), lengths)
    assert code.table.dtype == (np.int64 if length_bits > 5 else np.uint32)
    docs = np.arange(len(count)) * 7 - 3
    block = token_file.write_block(code, ids, docs, count)
    edge = np.concatenate([[0], np.cumsum(count)])
    words = [format(int(w) >> (64 - int(b)), f"0{b}b") for w, b in zip(code.word, code.bits)]
    want = b""
    for a, b in zip(edge[:-1], edge[1:]):
        bits = "".join(words[i] for i in ids[a:b])
        bits += "0" * (-len(bits) % 8)
        want += int(bits, 2).to_bytes(len(bits) // 8, "big")
    assert block.endswith(want)
    got, names, sizes = token_file.read_block(code, block)
    assert np.array_equal(got, ids)
    assert np.array_equal(names, docs) and np.array_equal(sizes, count)
