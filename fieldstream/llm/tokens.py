"""Token ids of whole texts by the tokenizers library, with a cache of words.

A byte-level BPE works word by word. Where a text has single spaces and line feeds only,
its space-separated pieces can be encoded one by one, so a piece that was seen before in
the worker is looked up. Other white space falls back to larger pieces, at worst the text.
"""

from __future__ import annotations

import codecs
import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fieldstream.llm.kernels import text_bytes

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Bytes of pieces and ids that each of a worker's two caches may hold; what is met after
#: that is encoded each time. (A larger cache is no faster: every lookup builds its table.)
CACHE_BYTES = 3 << 20
#: So many pieces are encoded as one text.
PIECES_A_TEXT = 256
SLICE_BYTES = 4 << 20
#: Latin, Greek and Cyrillic words; these ranges hold letters only, in any version of Unicode.
LETTERS = (r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{17F}\x{391}-\x{3A1}\x{3A3}-\x{3C9}"
           r"\x{400}-\x{481}]+$")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [x for x in range(256) if x not in _SHOWN]
#: The character that stands for each byte in a byte-level model.
ALPHABET = "".join(chr(x) if x in _SHOWN else chr(256 + _HIDDEN.index(x)) for x in range(256))
SIGNS = string.punctuation
#: So many signs behind letters are taken apart from them; what ends in more is one piece.
MOST_SIGNS = 16


class Words:
    """Ids of words of letters with a space before each, without the pre-tokenizer.

    Such a word is one piece to a byte-level BPE, so the library's model gets it in that
    model's alphabet and need not cut, map and align what is known beforehand. No entry of the
    vocabulary joins letters and a space behind them, so that words in a row are merged one by
    one even where nothing cuts them. A word's first id, and no other one, begins with the space.
    """

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer(tokenizer.model)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.first[[i for name, i in vocabulary.items() if name.startswith(ALPHABET[32])]] = True

    @classmethod
    def of(cls, tokenizer) -> "Words | None":
        """None for a tokenizer that is not known to work so."""
        from tokenizers import models, pre_tokenizers

        cut, model, space = tokenizer.pre_tokenizer, tokenizer.model, ALPHABET[32]
        plain = (isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex
                 and not cut.add_prefix_space and isinstance(model, models.BPE)
                 and not (model.dropout or model.continuing_subword_prefix
                          or model.end_of_word_suffix or model.ignore_merges)
                 and tokenizer.normalizer is None and tokenizer.post_processor is None
                 and tokenizer.truncation is None and tokenizer.padding is None)
        # The byte C2 begins signs only, so it is in none of the words.
        return cls(tokenizer) if plain and all(
            model.token_to_id(x) is not None for x in ALPHABET) and all(
            ALPHABET[0xC2] in x for x in tokenizer.get_vocab(with_added_tokens=False)
            if space in x.lstrip(space)) else None

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths, many words encoded as one text."""
        n = len(words)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        edge = np.append(np.arange(0, n, PIECES_A_TEXT), n)
        lists = pa.LargeListArray.from_arrays(pa.array(edge, pa.int64()),
                                              words.cast(pa.large_binary()))
        lines = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).to_pylist()
        got = self.tokenizer.encode_batch_fast(
            [codecs.charmap_decode(b" " + x, "strict", ALPHABET)[0] for x in lines],
            add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
        return ids, np.diff(np.flatnonzero(self.first[ids]), append=len(ids))


class Pieces:
    """Ids of pieces that are all encoded with the same text before them.

    Letters and the signs behind them (a comma, ``...``, ``$$$``) are two words to the encoder,
    so the letters are what is remembered and the ids of the signs are put behind them.
    """

    def __init__(self, tokenizer, before: str, words: Words | None = None):
        self.tokenizer, self.before, self.words = tokenizer, before, words
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        feed = tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of pieces; words of letters take the short way."""
        if self.words is None:
            return self._any(pieces)
        worded = pc.match_substring_regex(pieces, LETTERS).to_numpy(zero_copy_only=False)
        ids, length = self.words.encode(pieces.filter(pa.array(worded)))
        others, count = self._any(pieces.filter(pa.array(~worded)))
        return self._ordered(np.concatenate([ids, others]), np.concatenate([length, count]),
                             ~worded)

    @staticmethod
    def _ordered(ids: np.ndarray, length: np.ndarray, later: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths in the pieces' order, given with those marked ``later`` at the end."""
        order = np.argsort(later, kind="stable")
        start, count = np.empty((2, len(later)), np.int64)
        start[order], count[order] = np.cumsum(length) - length, length
        return gather(ids, start, count)[0], count

    def _any(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of any pieces.

        Pieces without white space are encoded many in a text, a line feed behind each: it
        is a token of its own there, and no such piece has that token.
        """
        length = np.zeros(len(pieces), np.int64)
        alone = np.ones(len(pieces), bool)
        if self.feed is not None:
            alone = pc.or_(pc.equal(pieces, ""), pc.match_substring_regex(pieces, WS)).to_numpy(
                zero_copy_only=False)
        runs: list[np.ndarray] = []
        names = pieces.filter(pa.array(~alone)).to_pylist()
        texts = ["".join([f"{self.before}{x}\n" for x in names[i:i + PIECES_A_TEXT]])
                 for i in range(0, len(names), PIECES_A_TEXT)]
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *[np.array(x.ids, np.uint32) for x in got]])
        feeds = np.flatnonzero(flat == self.feed) if names else np.zeros(0, np.int64)
        length[~alone] = np.diff(feeds, prepend=-1) - 1
        runs.append(np.delete(flat, feeds))
        if alone.any():
            got = self.tokenizer.encode_batch_fast(
                [self.before + x for x in pieces.filter(pa.array(alone)).to_pylist()],
                add_special_tokens=False)
            length[alone] = [len(x.ids) for x in got]
            runs += [np.array(x.ids, np.uint32) for x in got]
        # The ids lie in the order (many in a text, then alone); bring them to that of pieces.
        counts = np.concatenate([length[~alone], length[alone]])
        return self._ordered(np.concatenate(runs), counts, alone)

    def _remember(self, texts: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        """Keep the first of these pieces that the budget has room for."""
        room = CACHE_BYTES - self.known.nbytes - self.ids.nbytes - self.at.nbytes
        each = pc.binary_length(texts).to_numpy(zero_copy_only=False) + 16 + 4 * count
        n = int(np.searchsorted(np.cumsum(each), room, "right"))
        if n:
            self.known = pa.concat_arrays([self.known, texts.slice(0, n)])
            self.ids = np.concatenate([self.ids, ids[:int(count[:n].sum())]])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(count[:n])])

    def _find(self, values: pa.Array) -> np.ndarray:
        found = pc.index_in(values, value_set=self.known)
        return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def lookup(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n + 1 offsets of distinct values."""
        if not len(values):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        bare = pc.ascii_rtrim(values, characters=SIGNS)
        size = pc.binary_length(values).to_numpy(zero_copy_only=False)
        tail = size - pc.binary_length(bare).to_numpy(zero_copy_only=False)
        signed = (tail > 0) & (tail <= MOST_SIGNS) & pc.utf8_is_alpha(bare).to_numpy(
            zero_copy_only=False)
        cores = pc.if_else(pa.array(signed), bare, values)
        coded = cores.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        place = self._find(words)
        miss = np.flatnonzero(place < 0)
        ids, at = self.ids, self.at
        if len(miss):
            texts = words.take(pa.array(miss))
            fresh, count = self._new(texts)
            place[miss] = len(at) - 1 + np.arange(len(miss))
            ids = np.concatenate([ids, fresh])
            at = np.concatenate([at, at[-1] + np.cumsum(count)])
            self._remember(texts, fresh, count)
        # Two runs a value: that of the core and that of the signs.
        start, length = np.zeros((2, len(values), 2), np.int64)
        start[:, 0], length[:, 0] = at[place][index], np.diff(at)[place][index]
        if signed.any():
            behind, start[signed, 1], length[signed, 1] = self._signs(values, signed, tail)
            start[signed, 1] += len(ids)
            ids = np.concatenate([ids, behind])
        flat, edge = gather(ids, start.ravel(), length.ravel())
        return flat, edge[::2]

    def _signs(self, values: pa.Array, signed: np.ndarray, tail: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of the signs that end the marked values; start and length for each."""
        raw, edge = text_bytes(values)
        signs, at = gather(raw, (edge[1:] - tail)[signed], tail[signed])
        coded = pa.LargeStringArray.from_buffers(
            len(at) - 1, pa.py_buffer(at), pa.py_buffer(signs)).dictionary_encode()
        got = self.tokenizer.encode_batch_fast(coded.dictionary.to_pylist(),
                                               add_special_tokens=False)
        index = coded.indices.to_numpy(zero_copy_only=False)
        count = np.array([len(x.ids) for x in got])
        return (np.concatenate([np.array(x.ids, np.uint32) for x in got]),
                (np.cumsum(count) - count)[index], count[index])


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray
           ) -> tuple[np.ndarray, np.ndarray]:
    """The runs (start, length) of ``flat`` one after the other, and their offsets."""
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    pick = np.repeat(start - at[:-1], length) + np.arange(int(at[-1]))
    return flat[pick], at


class Encoder:
    """Whole texts to ids; one per worker, vocabulary file and treatment of added tokens.

    With ``added_tokens`` a text that holds the string of an added token is encoded whole, as
    the plain tokenizer does it; without, the strings of special tokens are ordinary text.
    """

    _held: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.added = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()
                      if added_tokens or not x.special]
        self.spaced = Pieces(self.tokenizer, " ", Words.of(self.tokenizer))
        self.bare = Pieces(self.tokenizer, "")

    @classmethod
    def of(cls, path: str, added_tokens: bool = False) -> "Encoder":
        key = (path, added_tokens)
        if key not in cls._held:
            cls._held[key] = cls(*key)
        return cls._held[key]

    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def slices(self, texts: pa.Array, most: int = SLICE_BYTES):
        """(first row, ids, offsets) for runs of rows of about ``most`` bytes; null is empty.

        Work on a slice takes some 25 times its bytes; smaller slices repeat more words.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            before = size[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(size, before + most, "right")))
            yield first, *self.encode(texts.slice(first, last - first))
            first = last

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        single = ~pc.match_substring_regex(texts, f"{WS}{WS}|^{WS}|{WS}$").to_numpy(
            zero_copy_only=False)
        # A space with white space before it and white space or the end behind it does not
        # start a piece; such texts are encoded whole, and so are those with an added token.
        whole = ~single
        whole[whole] = pc.match_substring_regex(
            texts.filter(pa.array(whole)), f"{WS} ({WS}|$)").to_numpy(zero_copy_only=False)
        holds = np.zeros(n, bool)
        for name in self.added:
            holds |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        whole, single = whole | holds, single & ~holds
        # A lone line feed is a token of its own: it ends a piece and starts a bare one.
        work = pc.if_else(pa.array(single), pc.replace_substring(texts, "\n", " \n "),
                          pc.if_else(pa.array(whole), "", texts))
        lists = pc.split_pattern(work, " ")
        flat = lists.flatten()
        edge = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        edge = edge - edge[0]
        bare = np.zeros(len(flat), bool)
        bare[edge[:-1]] = True
        feed = pc.equal(flat, "\n").to_numpy(zero_copy_only=False)
        feed &= np.repeat(single, np.diff(edge))
        bare |= feed
        bare[1:] |= feed[:-1]
        start = np.empty(len(flat), np.int64)
        length = np.empty(len(flat), np.int64)
        parts, base = [], 0
        for pieces, mask in ((self.spaced, ~bare), (self.bare, bare)):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            ids, at = pieces.lookup(coded.dictionary)
            index = coded.indices.to_numpy(zero_copy_only=False)
            start[mask], length[mask] = (at[:-1] + base)[index], np.diff(at)[index]
            parts.append(ids)
            base += len(ids)
        ids, at = gather(np.concatenate(parts), start, length)
        offsets = at[edge]
        odd = np.flatnonzero(whole & ~single)
        if len(odd):
            got = self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(),
                                                   add_special_tokens=False)
            runs = [ids[offsets[i]:offsets[i + 1]] for i in range(n)]
            for i, x in zip(odd.tolist(), got):
                runs[i] = np.array(x.ids, np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64)
            ids = np.concatenate(runs) if runs else ids
        return ids, offsets


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id behind each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] + np.arange(n)] = False
    out[inside] = ids
    return out, offsets + np.arange(n + 1)
