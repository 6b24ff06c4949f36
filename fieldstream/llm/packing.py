"""Documents into sequences of bounded length, with a certificate for each partition.

Pieces are dealt out over partitions and packed best-fit decreasing in each. Lower bounds
from dual feasible functions tell which partitions need every sequence they use; those are
done. In the others the sequences that are not full give their pieces back: these are dealt
out anew over partitions of the same size and packed again, until no gap is left, one
partition holds what is left, a new deal saves no sequence or ``ROUNDS`` deals are done.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import keep, small_batches
from fieldstream.llm.tokens import Encoder, with_end

CAPACITY = 2048
SLICE_BYTES = 2 << 20  # texts that are encoded at once
PIECES_A_PART = 40_000
#: Pieces are dealt out at most so often.
ROUNDS = 8
PIECE = "id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
        capacity: int = CAPACITY, end: int = 0, added_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and one end id, in pieces.

    Only documents longer than ``capacity`` are cut; all pieces but the first are full.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary, added_tokens)
        for batch in batches:
            for first, ids, at in encoder.slices(batch.column(1), SLICE_BYTES):
                ids, at = with_end(ids, at, end)
                n = np.diff(at)
                pieces = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(number == 0, 0, head[owner] + (number - 1) * capacity)
                length = np.where(number == 0, head[owner], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = (at[owner] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(
                    begin.tolist(), (begin + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)).take(pa.array(owner)),
                     pa.array(number.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])

    return (small_batches(docs).select(F.col(id_col).cast("long").alias("id"),
                                       F.col(text_col).cast("string").alias("text")).mapInArrow(K.tidy(run), PIECE))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs, from two families of dual feasible functions.

    f(x) counts a piece as a whole sequence above ``capacity - a``, by its length from a on
    and not at all below; u(x) rounds (k + 1) x / capacity down to k-ths unless it is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    below = np.cumsum(count)                 # pieces up to a length
    tokens = np.cumsum(count * size)
    a = np.arange(0, capacity // 2 + 1)
    whole = below[capacity] - below[capacity - a]
    middle = tokens[capacity - a] - np.where(a > 0, tokens[np.maximum(a - 1, 0)], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, 31):
        grown = (k + 1) * size
        share = np.where(grown % capacity == 0, k * size, (grown // capacity) * capacity)
        best = max(best, -(-int((count * share).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece by best-fit decreasing."""
    bins = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, used = 0, 0  # bit r is set while a sequence has exactly r tokens of room
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = some >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            mine = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            r, mine, used = capacity, used, used + 1
        bins[i], offset[i] = mine, capacity - r
        if r > n:
            room[r - n].append(mine)
            some |= 1 << (r - n)
    return bins, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY,
         pieces_a_part: int = PIECES_A_PART) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` is between 1 and ``capacity``.

    Full pieces are sequences of their own. A partition holds about ``pieces_a_part`` pieces
    in every round, so no task grows with the input. A deal that needs no fewer sequences
    than the one before is not used: the packing before it stands.
    """
    numbered = keep(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    done = [numbered.where(F.col("length") == capacity).select(
        "__row", (-F.col("__row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = numbered.where(F.col("length") < capacity).select("__row", "length")
    count, before, turn = left.count(), None, 0

    def place(fixed: DataFrame, of: int) -> None:
        done.append(fixed.select(
            "__row", (F.lit(of << 56) + F.shiftleft("part", 24) + F.col("bin"))
            .alias("sequence_id"), "offset"))

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "__row"], kind="stable", ignore_index=True)
        lengths = part["length"].to_numpy()
        bins, offset = best_fit(lengths, capacity)
        used = int(bins.max()) + 1
        full = np.bincount(bins, lengths) == capacity
        tight = used == lower_bound(lengths, capacity)
        return pd.DataFrame({
            "__row": part["__row"], "length": lengths, "part": part["part"], "bin": bins,
            "offset": offset, "settled": full[bins] | tight})

    while count:
        parts = max(1, math.ceil(count / pieces_a_part))
        tried = keep(
            left.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "__row"), F.lit(parts)))
            .groupBy("part").applyInPandas(
                one, "__row long, length long, part long, bin long, offset long, settled boolean"),
            "packed")
        # A sequence has one piece at offset 0.
        used, open_, count = tried.agg(
            F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & ~F.col("settled")),
            F.count_if(~F.col("settled"))).first()
        if before is not None and used >= before[1]:
            place(before[0], turn - 1)
            break
        if parts == 1 or turn + 1 == ROUNDS:
            place(tried, turn)
            break
        place(tried.where("settled"), turn)
        left = tried.where("not settled").select("__row", "length")
        before, turn = (tried.where("not settled"), open_), turn + 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return numbered.join(placed, "__row").drop("__row")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                   text_col: str = "text", capacity: int = CAPACITY,
                   added_tokens: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is the end id alone. Repeated rows are packed as often as they
    occur, a null id is kept, other columns are not read, an empty table gives no rows.
    ``added_tokens``: see ``Encoder``.
    """
    return pack(cut(docs, vocabulary, id_col, text_col, capacity, added_tokens=added_tokens),
                capacity).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id",
        "offset")
