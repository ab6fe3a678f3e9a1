"""Benchmark decontamination: spaced seeds find hits, substitution-tolerant overlaps verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawlytics.llm.common import mixed, powers, ragged, shared, slices, span_hashes, utf8, whole_text, word_spans
from drawlytics.plans.store import materialize

#: Token positions that a seed reads (1) and ignores (0).
MASKS = ("11111", "110111", "1011011", "1101011", "11100011")
#: Letters, digits and everything beyond ASCII make words; the rest separates them.
SEPARATOR = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
TABLE_BITS = 22
#: Words that an overlap may gain or lose in one place: so far apart alignments still add up.
SLACK = 8
#: Bytes of text looked at together.
CHUNK_BYTES = 1 << 20


def seeds(words: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``mask`` laid on every place of every text where it fits, and the places (word numbers)."""
    span, n = len(mask), len(words)
    if n < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    read = [i for i, c in enumerate(mask) if c == "1"]
    out = np.zeros(n - span + 1, dtype=np.uint64)
    for i, p in zip(read, powers(0xA24BAED4963EE407, len(read))):
        out += words[i : n - span + 1 + i] * p
    text = np.searchsorted(bounds, np.arange(n), side="right")
    fits = text[: n - span + 1] == text[span - 1 :]
    return mixed(out[fits]), np.flatnonzero(fits)


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    starts, ends, bounds = word_spans(data, offsets, SEPARATOR)
    return span_hashes(data, starts, ends, 7), bounds


class Items:
    """One shard of the benchmark: word hashes and, per mask, sorted seed hashes with item and place."""

    def __init__(self, texts: list[str], masks: Sequence[str], min_words: int, min_exact: int):
        self.words, self.bounds = _word_hashes(pa.array(texts, pa.string()))
        self.size = np.diff(self.bounds)
        whole = [("1" * n, self.size == n) for n in range(min_exact, min_words)]
        self.tables = []
        for mask, own in [*((m, self.size >= min_words) for m in masks), *whole]:
            if not own.any():
                continue
            h, place = seeds(self.words, self.bounds, mask)
            # Texts without a word repeat a bound; the last text that begins there owns the word.
            item = np.searchsorted(self.bounds, place, side="right") - 1
            keep = own[item]
            order = np.argsort(h[keep], kind="stable")
            h, item, place = h[keep][order], item[keep][order], place[keep][order]
            known = np.zeros(1 << TABLE_BITS, dtype=bool)
            known[(h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((mask, h, item, place - self.bounds[item], known))
        self.needed = np.where(self.size >= min_words, -1, self.size)

    def overlaps(self, column: pa.Array, identity: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, first word, equal words) of every verified overlap, the best of each row and item."""
        words, bounds = _word_hashes(column)
        found = [np.empty((0, 3), dtype=np.int64)]
        for mask, h, item, place, known in self.tables:
            own, at = seeds(words, bounds, mask)
            hit = known[(own & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]
            own, at = own[hit], at[hit]
            lo, hi = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            n = hi - lo
            entry = np.repeat(lo, n) + ragged(n)
            at = np.repeat(at, n)
            row = np.searchsorted(bounds, at, side="right") - 1
            found.append(np.column_stack([row, item[entry], at - place[entry]]))
        row, item, first = np.unique(np.concatenate(found), axis=0).T
        if not len(row):
            return
        # The part of the item that lies inside the text, word by word.
        size = self.size[item]
        begin, end = np.maximum(0, bounds[row] - first), np.minimum(size, bounds[row + 1] - first)
        length = end - begin
        place = np.repeat(begin, length) + ragged(length)
        equal = words[np.repeat(first, length) + place] == self.words[np.repeat(self.bounds[item], length) + place]
        starts = np.cumsum(length) - length
        same = np.add.reduceat(equal.astype(np.int64), starts)
        needed = np.where(self.needed[item] < 0, np.ceil(identity * size - 1e-9).astype(np.int64), size)
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(good: np.ndarray, r: np.ndarray, i: np.ndarray, f: np.ndarray, s: np.ndarray) -> None:
            for r, i, f, s in zip(r[good].tolist(), i[good].tolist(), np.maximum(f - bounds[r], 0)[good].tolist(), s[good].tolist()):
                if (-s, f) < best.get((r, i), (0, 0)):
                    best[r, i] = -s, f

        offer(same >= needed, row, item, first, same)
        # Alignments of one item a few words apart: added or missing words lie between them. Words count once, and only with an equal neighbour.
        apart = (np.diff(row) != 0) | (np.diff(item) != 0) | (np.diff(first) > SLACK)
        group = np.concatenate([[0], np.cumsum(apart)])
        several = np.bincount(group)[group] > 1
        inner = np.ones(len(equal), dtype=bool)
        inner[starts] = False
        pair = equal[1:] & equal[:-1] & inner[1:]
        firm = np.concatenate([[False], pair]) | np.concatenate([pair, [False]])
        owner = np.repeat(np.arange(len(row)), length)
        keep = firm & several[owner]
        cells = np.unique(np.column_stack([group[owner[keep]], place[keep]]), axis=0)
        both = np.bincount(cells[:, 0], minlength=group[-1] + 1)
        lead = np.unique(group, return_index=True)[1]
        offer((both >= needed[lead]) & (self.needed[item[lead]] < 0), row[lead], item[lead], first[lead], both)
        for (r, i), (s, f) in best.items():
            yield r, i, f, -s


def shards(benchmark: DataFrame, id_col: str, text_col: str, masks: Sequence[str], min_words: int, min_exact: int, shard_chars: int) -> Iterator[tuple[list, Items]]:
    """Ids and indexed items, at most about ``shard_chars`` characters at a time on the driver."""
    items = materialize(benchmark.select(F.col(id_col).alias("id"), F.lower(whole_text(text_col)).alias("text")), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / shard_chars))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], Items([r["text"] for r in rows], masks, min_words, min_exact)


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    identity: float = 0.8,
    min_words: int = 8,
    min_exact: int = 4,
    masks: Sequence[str] = MASKS,
    shard_chars: int = 4_000_000,
) -> DataFrame:
    """(id, item id, first_word, n_equal, n_item) for every item found in a document.

    Words are lower-cased runs of letters, digits and characters beyond ASCII.
    An item is found where at least ``identity`` of its words are equal to words
    of the document: on one alignment that a seed hit proposes, which may begin
    before the text or end behind it, or on alignments a few words apart, between
    which words were added or are missing. The best place of each item is
    returned per row. Items under ``min_words`` words must stand there whole and
    unchanged; those under ``min_exact`` are no evidence and never match. The seeds
    of ``shard_chars`` characters of the benchmark are joined at a time, broadcast
    by that bound; a larger benchmark takes more
    passes over the documents, which are never shuffled. Null texts match
    nothing, null ids and repeated rows come back as they are; other columns are
    ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col), F.lower(whole_text(text_col)).alias("_text"))
    item_type = benchmark.schema[item_id_col].dataType
    id_name, schema = slim.columns[0], slim.select(F.col(id_col)).schema
    schema = schema.add("_item", item_type).add("first_word", "long").add("n_equal", "long").add("n_item", "long")
    out = None
    for ids, items in shards(benchmark, item_id_col, item_text_col, masks, min_words, min_exact, shard_chars):
        held = shared(spark, (ids, items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, index = held()
            for batch in (part for whole in batches for part in slices(whole, 1, CHUNK_BYTES)):
                hits = list(index.overlaps(batch.column(1), identity))
                if hits:
                    row, item, first, same = map(list, zip(*hits))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array([names[i] for i in item]), pa.array(first, pa.int64()), pa.array(same, pa.int64()), pa.array([int(index.size[i]) for i in item], pa.int64())],
                        names=[id_name, "_item", "first_word", "n_equal", "n_item"],
                    )

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnRenamed("_item", item_id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **args) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, all columns kept."""
    row = "_decontam_row"
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    bad = materialize(contaminations(stored, benchmark, id_col=row, text_col=text_col, **args).select(row).distinct(), "leaks")
    return stored.join(bad, row, "left_anti").select(*docs.columns)
