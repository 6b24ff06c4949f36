"""Vectorised work on Arrow string columns inside one task: words, hashes, shingles.

All functions take whole texts. A batch is cut into runs of documents of bounded size, so
memory follows the batch and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Bytes of text that are worked on at once (a longer single text is worked on alone).
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_POSITION = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                      0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)


def release() -> None:
    """Give freed memory back to the system: workers outlive the tasks that needed it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable, each: bool = True) -> Callable:
    """A batch function that gives memory back after each batch that it yields.

    Without ``each`` only when it ends: batches that all need as much would fetch it anew.
    """
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            if each:
                release()
        release()

    return tidied


def ascii_space() -> np.ndarray:
    """True at the byte values of the space and of 0x09 to 0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def not_letter() -> np.ndarray:
    """True at the bytes that end a run of letters (digits, signs, spaces).

    Every byte beyond ASCII counts as a letter; ``blank`` takes out those that are none.
    """
    table = np.ones(256, dtype=bool)
    table[ord("a"):ord("z") + 1] = False
    table[ord("A"):ord("Z") + 1] = False
    table[0x80:] = False
    return table


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


SPACE, NOT_LETTER, LOWER = ascii_space(), not_letter(), lower_ascii()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser with full avalanche)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: What is no letter beyond ASCII, with marks that follow no letter; the second keeps numbers too.
NO_LETTERS = (r"(?:[^\x00-\x7F\p{L}\p{M}]|[\x00-@\[-`{-\x7F]\p{M}|^\p{M})"
              r"[^\x00-\x7F\p{L}]*")
NO_WORDS = (r"(?:[^\x00-\x7F\p{L}\p{M}\p{N}]|[\x00-/:-@\[-`{-\x7F]\p{M}|^\p{M})"
            r"[^\x00-\x7F\p{L}\p{N}]*")
#: A character of a script that is written without spaces, and its marks.
UNSPACED = (r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
            r"\p{M}*)")


def blank(column: pa.Array, signs: str) -> pa.Array:
    """Texts with one space for each run of ``signs``, so that byte tables see it as a gap."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.replace_substring_regex(column.cast(pa.large_string()), signs, " ")


def slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``most`` bytes, at least one text each: cut before any copy
    is made, so that what rewrites texts holds one slice and not the batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                     .astype(np.int64))
    for first, last in runs(np.concatenate([np.zeros(1, np.int64), size]), most):
        yield first, column.slice(first, last - first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]] if len(at) else raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def runs(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes, at least one document each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """The words of some texts: their places in ``raw`` and each document's range of words."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE):
        gap = breaks[raw]
        inside = ~gap
        before = np.ones(len(raw), dtype=bool)
        before[1:] = gap[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        before[edges] = True
        after = np.ones(len(raw), dtype=bool)
        after[:-1] = gap[1:]
        after[edges[edges > 0] - 1] = True
        self.raw = raw
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        #: word range of document d: first[d] to first[d + 1]
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hash_spans(self.raw, self.start, self.end)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)
        self.base = U64(0x5851F42D4C957F2D)
        self.inverse = U64(pow(int(self.base), -1, 1 << 64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(n, self.base, dtype=U64)
            back = np.full(n, self.inverse, dtype=U64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up, self.down


_POWERS = _Powers()


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray,
               most: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hashes of byte spans (ordered, not overlapping), from prefix sums."""
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, "right")))
        base, stop = int(start[i]), int(end[j - 1])
        up, down = _POWERS.upto(stop - base + 1)
        sums = np.zeros(stop - base + 1, dtype=U64)
        np.cumsum((raw[base:stop].astype(U64) + U64(1)) * up[:stop - base], out=sums[1:])
        a, b = start[i:j] - base, end[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * _ODD
        i = j
    return mix(out)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` neighbouring words, by the place of the first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.full(n, size, dtype=U64) * _ODD
    for k in range(size):
        factor = _POSITION[k % len(_POSITION)] + U64(2 * (k // len(_POSITION)))
        total += hashes[k:k + n] * factor
    return mix(total)


def shingle_sets(words: Words, hashes: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Per document its distinct shingles, ascending; fewer words make one shingle."""
    rolled = windows(hashes, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a:b - size + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, dtype=U64))
    return out
