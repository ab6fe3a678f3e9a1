"""Token ids in files: one canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

A written set of files is a folder with four tables. ``code``: (id, bits), the
code length of every id; the code words follow from the lengths, shorter ones
first and then by id. ``blocks``: (shard, block, start, doc_ids, sizes,
checkpoints, data); ``data`` holds the code words of whole documents, most
significant bit first, and ``checkpoints`` the bit offset of every 128th token.
``shards``: (shard, first), the number of ids in all shards before. ``format``:
(every,). Shards, blocks in a shard and documents in a block ascend by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from drawlytics.llm.common import input_tasks, utf8, whole_text
from drawlytics.llm.packing import worker_encoder
from drawlytics.plans.store import materialize

#: Longest code word that still fits a 32-bit window at any bit of its first byte.
WINDOW = 25
#: Tokens turned into bits at once.
SLICE = 1 << 18


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most ``limit`` bits (more if that many symbols need it).

    Package-merge: in each of ``limit`` rounds the symbols are merged by weight
    with pairs of the round before. What the last round takes is traced back; a
    symbol's length is the number of rounds that take it.
    """
    n = len(counts)
    if n < 2:
        return np.ones(n, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].astype(np.int64)
    rounds, pairs = [], weight[:0]
    for _ in range(max(limit, (n - 1).bit_length())):
        merged = np.concatenate([weight, pairs])
        by = np.argsort(merged, kind="stable")
        rounds.append(by < n)
        merged = merged[by]
        even = len(merged) // 2 * 2
        pairs = merged[0:even:2] + merged[1:even:2]
    sorted_lengths, take = np.zeros(n, dtype=np.int64), 2 * (n - 1)
    for symbol in reversed(rounds):
        own = int(symbol[:take].sum())
        sorted_lengths[:own] += 1
        take = 2 * (take - own)
    lengths = np.empty(n, dtype=np.int64)
    lengths[order] = sorted_lengths
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words by symbol (0 where unused, of length 0), and the used symbols in the order of their code words."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    size = lengths[order]
    longest = int(size.max(initial=0))
    # As fractions of the code space the words follow each other without gaps.
    share = np.int64(1) << (longest - size)
    words = np.zeros(len(lengths), dtype=np.uint32)
    words[order] = (np.cumsum(share) - share) >> (longest - size)
    return words, order


def encode(ids: np.ndarray, words: np.ndarray, lengths: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids`` and the bit offset of every ``every``-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros((int(ends[-1]) + 7) // 8 + 4 if len(ids) else 0, dtype=np.uint8)
    # Bytes that the longest code word can touch.
    touched = (int(size.max(initial=0)) + 14) // 8
    for a in range(0, len(ids), SLICE):
        at, own = starts[a : a + SLICE], size[a : a + SLICE]
        shifted = words[ids[a : a + SLICE]] << (32 - own - (at & 7)).astype(np.uint32)
        first = int(at[0]) >> 3
        byte = (at >> 3) - first
        room = int(byte[-1]) + 4
        total = sum(np.bincount(byte + k, (shifted >> np.uint32(24 - 8 * k)) & np.uint32(255), room + k)[:room] for k in range(touched))
        # Words share bytes but no bits, so sums are unions.
        out[first : first + room] |= total.astype(np.uint8)
    return out[: len(out) - 4].tobytes() if len(ids) else b"", starts[::every]


class Decoder:
    """Table-driven decoding: the next ``longest`` bits name the symbol and its length."""

    def __init__(self, lengths: np.ndarray):
        _, order = canonical(lengths)
        size = lengths[order]
        self.longest = int(size.max(initial=1))
        times = np.int64(1) << (self.longest - size)
        self.symbol = np.zeros(1 << self.longest, dtype=np.uint32)
        self.size = np.zeros(1 << self.longest, dtype=np.int64)
        self.symbol[: times.sum()] = np.repeat(order, times)
        self.size[: times.sum()] = np.repeat(size, times)

    def decode(self, data: bytes, checkpoints: np.ndarray, n: int, every: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` (all by default) of a block of ``n``.

        All stretches between checkpoints are decoded side by side, one id of each a turn.
        """
        last = n if last is None else min(last, n)
        if first >= last:
            return np.empty(0, dtype="<u4")
        lane = first // every
        at = checkpoints[lane : -(-last // every)].astype(np.int64)
        # The last stretch may be shorter than the others and runs into zeros.
        raw = np.frombuffer(data + bytes(every * self.longest // 8 + 8), dtype=np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        spare = np.uint32(32 - self.longest)
        out = np.empty((every, len(at)), dtype="<u4")
        for k in range(min(every, last - lane * every)):
            bits = (window[at >> 3] << (at & 7).astype(np.uint32)) >> spare
            out[k] = self.symbol[bits]
            at += self.size[bits]
        return out.T.ravel()[first - lane * every : last - lane * every]


def _token_rows(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int, width: int, known_words: int) -> DataFrame:
    """(id, ids) per row: little-endian ids of ``width`` bytes, the end id last."""
    slim = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    schema = slim.select("id").schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer_path, known_words), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in encoder.encode(part.column(1), end)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "ids"])

    return slim.mapInArrow(run, schema)


def _counts(rows: DataFrame, width: int, kinds: int) -> np.ndarray:
    """Uses of every id; at most one number per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds, dtype=np.int64)
        for batch in batches:
            data, _ = utf8(batch.column(0))
            total += np.bincount(data.view(f"<u{width}"), minlength=kinds)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(kinds, dtype=np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def _blocks(rows: DataFrame, lengths: np.ndarray, width: int, block_tokens: int, every: int) -> DataFrame:
    """The blocks of every task of ``rows`` (id, ids; in order), each of whole documents."""
    lengths_of = rows.sparkSession.sparkContext.broadcast(lengths.astype(np.uint8))
    schema = StructType().add("shard", "integer").add("block", "integer").add("start", "long")
    schema = schema.add("doc_ids", ArrayType(rows.schema["id"].dataType)).add("sizes", ArrayType(IntegerType())).add("checkpoints", ArrayType(LongType())).add("data", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lengths_of.value.astype(np.int64)
        words, _ = canonical(bits)
        shard = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        block, start, tokens = 0, 0, 0

        def one() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            data, offsets = utf8(whole.column(1))
            coded, checkpoints = encode(data.view(f"<u{width}"), words, bits, every)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (whole.column(0), pa.array(np.diff(offsets) // width, pa.int32()), pa.array(checkpoints, pa.int64()))]
            single = [pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (start, pa.int64()))]
            return pa.RecordBatch.from_arrays([*single, *lists, pa.array([coded], pa.binary())], names=schema.names)

        for batch in batches:
            _, offsets = utf8(batch.column(1))
            ends = offsets[1:] // width
            first = 0
            while first < batch.num_rows:
                before = int(offsets[first]) // width
                last = min(int(np.searchsorted(ends, before + block_tokens - tokens)) + 1, batch.num_rows)
                held.append(batch.slice(first, last - first))
                tokens += int(ends[last - 1]) - before
                if tokens >= block_tokens:
                    yield one()
                    block, start, tokens, held = block + 1, start + tokens, 0, []
                first = last
        if held:
            yield one()

    return rows.select("id", "ids").mapInArrow(run, schema)


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    longest: int = 16,
    every: int = 128,
    block_tokens: int = 1 << 18,
    shard_tokens: int = 1 << 26,
    known_words: int = 1_000_000,
) -> None:
    """Encodes every document and writes the files described above to the new folder ``path``.

    A document is the tokenizer's ids of its text, then ``end_id``; a null or
    empty text is that id alone. Documents ascend by id, null ids first, repeated
    ids by their row, so one id with most of the rows is still spread over
    shards. Other columns are ignored; an empty table gives files without
    blocks. ``longest`` bounds the bits of a code word unless the vocabulary
    needs more.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    kinds = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    width = 2 if kinds <= 1 << 16 else 4
    rows = _token_rows(docs, tokenizer_path, id_col, text_col, end_id, width, known_words)
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    counts = _counts(rows, width, kinds)
    used = np.flatnonzero(counts)
    lengths = np.zeros(kinds, dtype=np.int64)
    lengths[used] = code_lengths(counts[used], longest)
    if lengths.max() > WINDOW:
        raise ValueError(f"code words of up to {lengths.max()} bits; at most {WINDOW} can be read")
    code = pa.table({"id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used], pa.int32())})
    spark.createDataFrame(code).coalesce(1).write.parquet(f"{path}/code")
    spark.createDataFrame([(every,)], "every int").coalesce(1).write.parquet(f"{path}/format")
    parts = max(input_tasks(docs), -(-int(counts.sum()) // shard_tokens))
    order = [F.col("id").asc_nulls_first(), F.col("row")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    _blocks(ordered, lengths, width, block_tokens, every).write.option("compression", "none").parquet(f"{path}/blocks")
    # One row per shard: as many as tasks wrote blocks.
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    shards.coalesce(1).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document of written files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    unsigned 32-bit integers. Every block is decoded by itself.
    """
    code = spark.read.parquet(f"{path}/code").toArrow()
    (every,) = spark.read.parquet(f"{path}/format").first()
    ids = code.column("id").to_numpy()
    lengths = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.uint8)
    lengths[ids] = code.column("bits").to_numpy()
    lengths_of = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{path}/blocks")
    # One row per shard.
    placed = blocks.join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    placed = placed.select((F.col("first") + F.col("start")).alias("start"), "doc_ids", "sizes", "checkpoints", "data")
    schema = StructType().add("doc_id", blocks.schema["doc_ids"].dataType.elementType).add("start", "long").add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths_of.value.astype(np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, sizes, checkpoints, data = (batch.column(k)[i] for k in range(5))
                sizes = sizes.values.to_numpy().astype(np.int64)
                ends = np.cumsum(sizes)
                found = decoder.decode(data.as_py(), checkpoints.values.to_numpy(), int(ends[-1]), every)
                offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype("<i8"))
                ids = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(np.ascontiguousarray(found))])
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(start.as_py() + ends - sizes), pa.array(sizes), ids.cast(pa.binary())], names=schema.names)

    return placed.mapInArrow(run, schema)
