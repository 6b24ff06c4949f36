"""Token ids as Huffman-coded blocks, in ascending order of documents.

A file set is a folder with two Parquet tables. ``code`` holds the length of each id's code
word; the words themselves are canonical. ``blocks`` holds independent binary blocks:

====================  ========================================================
4 x uint32            documents, code bytes, checkpoints, tokens
documents x int64     document ids
documents x uint32    tokens of each document
documents x uint64    first code byte of each document
checkpoints x uint32  per document and 256 tokens the bit offset in the document
code bytes            the code words, most significant bit first; a document starts
                      at a byte
====================  ========================================================

All numbers are little-endian. A block can be read without any other one, and inside it
every checkpoint starts a run that is decoded by table look-ups on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldstream.llm import kernels as K
from fieldstream.llm.common import maybe_broadcast, small_batches
from fieldstream.llm.tokens import Encoder, with_end
from fieldstream.session import run_dir

RUN = 256
LONGEST = 18
LENGTH_BITS = 5
TOKENS_A_BLOCK = 1 << 20
TOKENS_A_SHARD = 8 << 20
#: Stands for a null document id inside a block.
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for count 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError("more symbols than code words")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    weights, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(longest - 1):
        even = len(weights) // 2 * 2
        package = weights[0:even:2] + weights[1:even:2]
        both = np.concatenate([leaf, package])
        rank = np.argsort(both, kind="stable")
        weights = both[rank]
        is_leaf.append(rank < n)
    # Back from the last list: its first 2n - 2 entries; a package stands for two below.
    take, length = 2 * n - 2, np.zeros(n, np.int64)
    for level in reversed(is_leaf):
        leaves = int(level[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


class Code:
    """Canonical code words and their decoding table."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        self.symbols = symbols[order].astype(np.uint32)
        self.lengths = lengths[order].astype(np.int64)
        self.width = int(self.lengths.max()) if len(order) else 1
        span = np.int64(1) << (self.width - self.lengths)
        first = np.cumsum(span) - span
        size = int(symbols.max()) + 1 if len(symbols) else 1
        #: An id's code word at the left end of 64 bits, and its length.
        self.word = np.zeros(size, np.uint64)
        self.bits = np.zeros(size, np.int64)
        self.word[self.symbols] = first.astype(np.uint64) << np.uint64(64 - self.width)
        self.bits[self.symbols] = self.lengths
        #: For every ``width`` bits the id that they begin with, and its length in the low bits.
        wide = size > 1 << (32 - LENGTH_BITS)
        self.table = np.ones(1 << self.width, np.int64 if wide else np.uint32)
        self.table[:int(span.sum())] = np.repeat(
            self.symbols.astype(np.uint64) << np.uint64(LENGTH_BITS)
            | self.lengths.astype(np.uint64), span)


def _runs(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of ``RUN`` ids its document and its number there."""
    runs = -(-count // RUN)
    owner = np.repeat(np.arange(len(count)), runs)
    return owner, np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner]


def write_block(code: Code, ids: np.ndarray, docs: np.ndarray, count: np.ndarray) -> bytes:
    """One block of the documents ``docs`` with ``count`` ids each."""
    edge = np.concatenate([[0], np.cumsum(count)])
    bit = np.concatenate([[0], np.cumsum(code.bits[ids])])
    begin = bit[edge[:-1]]
    doc_bytes = -(-(bit[edge[1:]] - begin) // 8)
    first = np.concatenate([[0], np.cumsum(doc_bytes)])
    owner, turn = _runs(count)
    check = bit[edge[owner] + turn * RUN] - begin[owner]
    place = bit[:-1] + np.repeat(8 * first[:-1] - begin, count)
    value = code.word[ids] >> (place & 31).astype(np.uint64)
    # What begins in the same 32 bits shares no bit, so that it is added up at once.
    at = place >> 5
    new = np.flatnonzero(np.diff(at, prepend=-1))
    at, value = at[new], np.add.reduceat(value, new)
    words = np.zeros(int(first[-1]) // 4 + 3, np.uint64)
    words[at] = value >> np.uint64(32)
    words[at + 1] += value & np.uint64(0xFFFFFFFF)
    data = words.astype(">u4").tobytes()[:int(first[-1])]
    head = np.array([len(docs), len(data), len(check), len(ids)], "<u4")
    return b"".join([head.tobytes(), docs.astype("<i8").tobytes(), count.astype("<u4").tobytes(),
                     first[:-1].astype("<u8").tobytes(), check.astype("<u4").tobytes(), data])


def read_block(code: Code, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document ids, ids of each document); all runs of the block advance together."""
    n, size, checks, total = np.frombuffer(block, "<u4", 4).tolist()
    at = 16
    docs = np.frombuffer(block, "<i8", n, at)
    count = np.frombuffer(block, "<u4", n, at + 8 * n).astype(np.int64)
    first = np.frombuffer(block, "<u8", n, at + 12 * n).astype(np.int64)
    check = np.frombuffer(block, "<u4", checks, at + 20 * n).astype(np.int64)
    data = np.zeros(size + 8, np.uint32)
    data[:size] = np.frombuffer(block, np.uint8, size, at + 20 * n + 4 * checks)
    pair = data[:-1] << np.uint32(8) | data[1:]
    view = pair[:-2] << np.uint32(16) | pair[2:]
    owner, turn = _runs(count)
    bit = check + 8 * first[owner]
    left = np.minimum(RUN, count[owner] - turn * RUN)
    edge = np.concatenate([[0], np.cumsum(count)])
    target = edge[owner] + turn * RUN
    out = np.zeros(total, np.uint32)
    # Longest runs first: the runs that go on are always a head of the arrays.
    order = np.argsort(-left, kind="stable")
    bit, left, target = bit[order], left[order], target[order]
    alive = np.searchsorted(-left, -np.arange(int(left.max()) if checks else 0), "left")
    room, low = 32 - code.width, (1 << LENGTH_BITS) - 1
    for step, k in enumerate(alive.tolist()):
        here = bit[:k]
        # The bits before ``here`` leave at the left, those behind the word at the right.
        ahead = view.take(here >> 3) << (here & 7).astype(np.uint32)
        entry = code.table.take(ahead >> room)
        out[target[:k] + step] = entry >> LENGTH_BITS
        here += entry & low
    return out, docs, count


def checksums(ids: np.ndarray, edge: np.ndarray) -> list[int]:
    """The crc32 of each document's ids as unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
    at = (4 * edge).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]


def write(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id",
          text_col: str = "text", end: int = 0, added_tokens: bool = False) -> None:
    """Encode the texts (null: empty), an end id behind each, and write the file set.

    The ids are written once beside the blocks; counts over all of them give the code (at
    most one row per id of the vocabulary comes to the driver). Rows are ordered by id, then
    by content; a null id comes first.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary, added_tokens)
        kind = "<u2" if encoder.vocabulary() <= 1 << 16 else "<u4"
        for batch in batches:
            for first, ids, at in encoder.slices(batch.column(1)):
                ids, at = with_end(ids, at, end)
                n, w = len(at) - 1, int(kind[-1])
                runs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n,
                    [None, pa.py_buffer(w * at), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.diff(at)),
                     pa.array(checksums(ids, at), pa.int64()), pa.array([w] * n, pa.int32()),
                     runs.cast(pa.binary())], ["id", "n", "crc", "width", "ids"])

    layout = "id long, n long, crc long, width int, ids binary"
    (small_batches(docs).select(F.col(id_col).cast("long").alias("id"),
                 F.col(text_col).cast("string").alias("text"))
     .mapInArrow(K.tidy(encode, False), layout).write.option("compression", "zstd").parquet(f"{path}/ids"))
    held = spark.read.schema(layout).parquet(f"{path}/ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for w in pc.unique(batch.column(0)).to_pylist():
                runs = batch.column(1).filter(pc.equal(batch.column(0), w))
                _, edge, data = runs.cast(pa.large_binary()).buffers()
                size = int(np.frombuffer(edge, np.int64)[len(runs)])
                got = np.bincount(np.frombuffer(data, f"<u{w}", size // w), minlength=len(total))
                got[:len(total)] += total
                total = got
        symbol = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int64()),
                                          pa.array(total[symbol], pa.int64())],
                                         ["symbol", "count"])

    counts = (held.select("width", "ids").mapInArrow(tally, "symbol long, count long")
              .groupBy("symbol").agg(F.sum("count").alias("count")).toArrow())
    symbol = counts["symbol"].to_numpy()
    dense = np.zeros(int(symbol.max()) + 1 if len(symbol) else 1, np.int64)
    dense[symbol] = counts["count"].to_numpy()
    lengths = code_lengths(dense)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        pa.table({"symbol": pa.array(used, pa.int64()),
                  "length": pa.array(lengths[used], pa.int32())})
    ).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((used, lengths[used]))
    shards = max(1, -(-int(dense.sum()) // TOKENS_A_SHARD))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        shard = TaskContext.get().partitionId()
        number = 0
        held_ids: list[np.ndarray] = []
        held_docs: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held_ids, held_docs, size
            ids = np.concatenate(held_ids).astype(np.int64)
            count = np.array([len(x) for x in held_ids])
            data = write_block(code, ids, np.array(held_docs, np.int64), count)
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([number], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                ["shard", "block", "tokens", "data"])
            number, held_ids, held_docs, size = number + 1, [], [], 0
            return row

        for batch in batches:
            for doc, w, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                   batch.column(2).to_pylist()):
                run = np.frombuffer(raw, f"<u{w}")
                held_ids.append(run)
                held_docs.append(NULL_ID if doc is None else doc)
                size += len(run)
                if size >= TOKENS_A_BLOCK:
                    yield flush()
        if held_ids:
            yield flush()

    order = ["id", "crc", "n"]
    (held.repartitionByRange(shards, *order).sortWithinPartitions(*order)
     .select("id", "width", "ids")
     .mapInArrow(K.tidy(blocks, False), "shard long, block long, tokens long, data binary")
     .write.option("compression", "none").parquet(f"{path}/blocks"))


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, decoded from the file set."""
    table = spark.read.schema("symbol long, length int").parquet(f"{path}/code").toArrow()
    shared = spark.sparkContext.broadcast(
        (table["symbol"].to_numpy(), table["length"].to_numpy()))
    stored = spark.read.schema("shard long, block long, tokens long, data binary").parquet(
        f"{path}/blocks")
    # One row a block; a block's start is the sum of all before it.
    sizes = stored.select("shard", "block", "tokens")
    shard = sorted((r[0], r[1]) for r in
                   sizes.groupBy("shard").agg(F.sum("tokens")).collect())
    begin, total = [], 0
    for number, tokens in shard:
        begin.append((number, total))
        total += tokens
    first = spark.createDataFrame(begin, "__shard long, __base long")
    within = F.sum("tokens").over(Window.partitionBy("shard").orderBy("block")
                                  .rowsBetween(Window.unboundedPreceding, -1))
    starts = (sizes.withColumn("before", F.coalesce(within, F.lit(0)))
              .join(maybe_broadcast(first, len(begin)), F.col("shard") == F.col("__shard"))
              .select(F.col("shard").alias("__s"), F.col("block").alias("__b"),
                      (F.col("before") + F.col("__base")).alias("base")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for shard_no, number, data in zip(*(batch.column(k) for k in range(3))):
                ids, docs, count = read_block(code, data.as_buffer().to_pybytes())
                edge = np.concatenate([[0], np.cumsum(count)])
                crc = checksums(ids, edge)
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard_no.as_py()] * n, pa.int64()),
                     pa.array([number.as_py()] * n, pa.int64()),
                     pa.array(docs, mask=docs == NULL_ID), pa.array(edge[:-1]),
                     pa.array(count), pa.array(crc, pa.int64())],
                    ["shard", "block", "id", "inside", "n", "crc"])

    got = stored.select("shard", "block", "data").mapInArrow(
        K.tidy(decode, False), "shard long, block long, id long, inside long, n long, crc long")
    return (got.join(starts, (F.col("shard") == F.col("__s")) & (F.col("block") == F.col("__b")))
            .select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"),
                    F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")))


def store_and_read(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                   text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Write the file set to the shared folder and answer from what is read back.

    A null or empty text is the end id alone; repeated rows stand side by side; other
    columns are not read; an empty table gives an empty file set and no rows.
    ``added_tokens``: see ``Encoder``.
    """
    path = run_dir(docs.sparkSession, "token-file")
    write(docs, path, vocabulary, id_col, text_col, added_tokens=added_tokens)
    return read(docs.sparkSession, path, id_col)
