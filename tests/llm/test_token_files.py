import heapq
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawlytics.llm import token_files
from drawlytics.plans.store import session_root

PATH = public_tokenizers.path("word_bpe_49k.json")


def folder(spark):
    return f"{session_root(spark)}/tokens-{uuid.uuid4().hex}"


def expected(rows):
    """(doc_id, start, n_tokens, crc) in file order of (doc_id, text) rows."""
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for own, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((own, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def files(spark, docs, **args):
    path = folder(spark)
    token_files.write(docs, path, PATH, **args)
    rows = token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    return path, sorted(map(tuple, rows), key=lambda r: r[1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60), st.integers(6, 16))
def test_lengths_are_an_optimal_limited_prefix_code(counts, limit):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -lengths) == 1
    free = token_files.code_lengths(counts, 60)
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        two = heapq.heappop(heap) + heapq.heappop(heap)
        cost += two
        heapq.heappush(heap, two)
    assert (free * counts).sum() == cost <= (lengths * counts).sum()


def test_limit_that_binds():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21])  # seven bits without a limit
    assert token_files.code_lengths(counts, 60).max() == 7
    lengths = token_files.code_lengths(counts, 4)
    best = min(
        (sum(c * l for c, l in zip(counts, ls)) for ls in combinations_of(8, 4) if sum(2.0**-l for l in ls) <= 1), default=None
    )
    assert lengths.max() == 4 and (lengths * counts).sum() == best


def combinations_of(n, limit):
    from itertools import combinations_with_replacement

    # Rarer symbols never have shorter words.
    return (sorted(c, reverse=True) for c in combinations_with_replacement(range(1, limit + 1), n))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=700), st.integers(1, 64), st.data())
def test_blocks_come_back_from_any_checkpoint(ids, every, data):
    ids = np.array(ids)
    lengths = np.zeros(41, dtype=np.int64)
    used, counts = np.unique(ids, return_counts=True)
    lengths[used] = token_files.code_lengths(counts, 6)
    words, _ = token_files.canonical(lengths)
    bits, checkpoints = token_files.encode(ids, words, lengths, every)
    assert len(bits) == -(-int(lengths[ids].sum()) // 8)
    decoder = token_files.Decoder(lengths)
    assert decoder.decode(bits, checkpoints, len(ids), every).tolist() == ids.tolist()
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert decoder.decode(bits, checkpoints, len(ids), every, a, b).tolist() == ids[a:b].tolist()


def test_code_words_are_canonical():
    words, order = token_files.canonical(np.array([2, 0, 1, 3, 3]))
    assert order.tolist() == [2, 0, 3, 4] and words.tolist() == [0b10, 0, 0b0, 0b110, 0b111]


def test_files_give_back_every_document(spark, documents):
    """Against the tokenizer itself, with blocks and shards far smaller than by default."""
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    path, got = files(spark, documents, block_tokens=500, every=16, shard_tokens=5000)
    assert got == expected(rows)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.count() > 50 and blocks.select("shard").distinct().count() > 8
    lists = blocks.orderBy("shard", "block").select("doc_ids").collect()
    ids = [i for r in lists for i in r["doc_ids"]]
    assert ids == sorted(ids)
    tokens = sum(r[2] for r in got)
    assert blocks.agg(F.sum(F.length("data"))).first()[0] < 2 * tokens


def test_default_sizes(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert files(spark, documents)[1] == expected(rows)


def test_odd_rows(spark, odd):
    """Null ids first, repeated ids one after the other, null and empty texts as the end id alone."""
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert files(spark, odd)[1] == expected(rows)
    assert files(spark, odd.where("text IS NULL"))[1] == [(3, 0, 1, zlib.crc32(b"\2\0\0\0"))]


def test_empty_table(spark, none):
    path, got = files(spark, none)
    assert got == [] and spark.read.parquet(f"{path}/code").isEmpty()
    assert token_files.read(spark, path).columns == ["doc_id", "start", "n_tokens", "ids"]


def test_one_id_with_most_rows_fills_several_shards(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("one two three "), "id").alias("text"))
    path, got = files(spark, docs)
    assert spark.read.parquet(f"{path}/blocks").select("shard").distinct().count() == 8
    assert len(got) == 4000 and [a[1] + a[2] for a in got[:-1]] == [b[1] for b in got[1:]]


def test_too_long_code_words_are_refused(spark, documents, monkeypatch):
    monkeypatch.setattr(token_files, "WINDOW", 3)
    with pytest.raises(ValueError, match="bits"):
        token_files.write(documents, folder(spark), PATH)
