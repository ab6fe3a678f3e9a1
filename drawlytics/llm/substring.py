"""Substring dedup: repeated word windows, counted in buckets of super-k-mers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from drawlytics.llm.common import SPACE_BYTES, input_tasks, mixed, powers, ragged, slices, span_hashes, utf8, whole_text, word_spans
from drawlytics.plans.store import materialize

#: Bytes of text whose super-k-mers are packed together.
CHUNK_BYTES = 8 << 20
#: Windows of a super-k-mer at most: a text of one repeated word is cut, not shipped as one string.
LONGEST = 256
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F)
PACKED = "bucket long, packed binary, keys binary, starts binary, ends binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, size = len(x), 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = n - width + 1
    return np.minimum(x[:rest], x[width - size : width - size + rest])


def _mer_hashes(words: np.ndarray, mer: int) -> np.ndarray:
    """A 63-bit hash of every ``mer`` consecutive words."""
    n = len(words) - mer + 1
    value = np.zeros(n, dtype=np.uint64)
    for i, p in enumerate(powers(BASES[0], mer)):
        value += words[i : n + i] * p
    return mixed(value) >> np.uint64(1)


def minimisers(words: np.ndarray, bounds: np.ndarray, window: int, mer: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers where windows start, the text of each, and its minimiser.

    The minimiser is the least hash of ``mer`` consecutive words. Hot ones come
    after all others, so a window takes one only if it has nothing rarer; such
    windows are told apart by the least hash of half as many words as a window has,
    so a hot minimiser is dealt to many buckets.
    """
    size = np.diff(bounds)
    count = np.maximum(size - window + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    at = bounds[:-1][text] + ragged(count)
    if not len(at):
        return at, text, np.empty(0, dtype=np.uint64)
    value = _mer_hashes(words, mer)
    if not len(hot):
        return at, text, sliding_min(value, window - mer + 1)[at]
    place = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
    value |= (hot[place] == value).astype(np.uint64) << np.uint64(63)
    value = sliding_min(value, window - mer + 1)[at]
    common = np.flatnonzero(value >> np.uint64(63))
    if len(common):
        longer = max(mer, (window + 1) // 2)
        value[common] = mixed(value[common] + sliding_min(_mer_hashes(words, longer), window - longer + 1)[at[common]])
    return at, text, value


def minimiser_counts(docs: DataFrame, window: int, mer: int) -> DataFrame:
    """(minimiser, n, windows): super-k-mers of each minimiser and windows in them, folded per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Nothing here gains from large chunks.
            for part in slices(batch, 0, CHUNK_BYTES // 4):
                data, offsets = utf8(part.column(0))
                starts, ends, bounds = word_spans(data, offsets, SPACE_BYTES)
                _, text, value = minimisers(span_hashes(data, starts, ends, 3), bounds, window, mer, np.empty(0, np.uint64))
                new = np.ones(len(value), dtype=bool)
                new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                found, own, n = np.unique(value[head], return_inverse=True, return_counts=True)
                windows = np.bincount(own, np.diff(np.append(head, len(value))), len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n, pa.int64()), pa.array(windows)], names=["minimiser", "n", "windows"])

    rows = docs.mapInArrow(run, "minimiser long, n long, windows long")
    return rows.groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("windows").alias("windows"))


def pack_chunk(part: pa.RecordBatch, window: int, mer: int, hot: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of PACKED for one chunk of (text, k1, k2).

    Texts and super-k-mers found twice within the chunk are known to repeat:
    they go on as ranges (no ``packed``), and only the first is shipped.
    """
    data, offsets = utf8(part.column(0))
    key = np.column_stack([part.column(i).to_numpy() for i in (1, 2)]).astype(np.int64)
    starts, ends, bounds = word_spans(data, offsets, SPACE_BYTES)
    at, text, value = minimisers(span_hashes(data, starts, ends, 3), bounds, window, mer, hot)
    if not len(at):
        return
    size = np.diff(bounds)
    _, first, group, n = np.unique(key[:, 0], return_index=True, return_inverse=True, return_counts=True)
    copies = np.flatnonzero((n[group] > 1) & (size >= window))
    known = [(copies, np.zeros(len(copies), np.int64), size[copies] - window + 1)]
    shipped = first[group] == np.arange(len(size))
    keep = shipped[text]
    at, text, value = at[keep], text[keep], value[keep]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(at)))
    pieces = -(-run // LONGEST)
    head = np.repeat(head, pieces) + ragged(pieces) * LONGEST
    run = np.diff(np.append(head, len(at)))
    # The words of all texts, each followed by one space.
    length = ends - starts
    place = np.cumsum(length + 1) - length - 1
    line = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    taken = np.ones(len(line), dtype=bool)
    taken[place + length] = False
    line[taken] = data[~SPACE_BYTES[data]]
    line = line.tobytes()
    word = at[head]
    end_word = word + run + window - 2
    text, lo = text[head], word - bounds[:-1][text[head]]
    seen: dict[bytes, int] = {}
    source = [seen.setdefault(line[a:b], i) for i, (a, b) in enumerate(zip(place[word].tolist(), (place[end_word] + length[end_word]).tolist()))]
    source = np.array(source)
    again = np.flatnonzero(source != np.arange(len(source)))
    twice = np.union1d(again, source[again])
    known.append((text[twice], lo[twice], lo[twice] + run[twice]))
    texts = list(seen)
    kept = np.flatnonzero(source == np.arange(len(source)))
    bucket = (mixed(value[head[kept]]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    zip_ = zstandard.ZstdCompressor(level=3)
    for own in np.split(order, cuts):
        ref = kept[own]
        yield int(bucket[own[0]]), zip_.compress(b"\n".join([texts[i] for i in own.tolist()])), key[text[ref]].tobytes(), lo[ref].astype("<i4").tobytes(), None
    row, lo, hi = (np.concatenate(x) for x in zip(*known))
    where = (key[row, 1].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(own):
            yield int(where[own[0]]), None, key[row[own]].tobytes(), lo[own].astype("<i4").tobytes(), hi[own].astype("<i4").tobytes()


def _window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """A hash of every ``window`` consecutive words, by prefix sums in the ring of 2^64."""
    n = len(words)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(base, n), out=prefix[1:])
    back = powers(pow(base, -1, 1 << 64), n - window + 1)
    return (prefix[window:] - prefix[: n - window + 1]) * back


def repeated_ranges(packed: list[bytes], keys: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and window ranges of one bucket's windows that occur twice or more.

    Windows are sorted by 128 hash bits; equal neighbours are then compared as strings.
    """
    line = b"\n".join(packed)
    data = np.frombuffer(line, dtype=np.uint8)
    cuts = np.flatnonzero(data == 10)
    offsets = np.concatenate([[0], cuts + 1, [len(data)]])
    first, last, bounds = word_spans(data, offsets, SPACE_BYTES)
    words = span_hashes(data, first, last, 5)
    count = np.diff(bounds) - window + 1
    owner = np.repeat(np.arange(len(count)), count)
    at = bounds[:-1][owner] + ragged(count)
    h1, h2 = (_window_hashes(words if i == 0 else mixed(words + np.uint64(11)), window, b)[at] for i, b in enumerate(BASES))
    order = np.lexsort((h2, h1))
    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    flag = np.zeros(len(at), dtype=bool)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        member = order[a : b + 1]
        texts = [line[s:e] for s, e in zip(first[at[member]].tolist(), last[at[member] + window - 1].tolist())]
        if texts.count(texts[0]) == len(texts):
            flag[member] = True
        else:
            n = Counter(texts)
            flag[member] = [n[t] > 1 for t in texts]
    hit = np.flatnonzero(flag)
    if not len(hit):
        return keys[:0], starts[:0], starts[:0]
    head = np.ones(len(hit), dtype=bool)
    head[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
    head = np.flatnonzero(head)
    tail = np.append(head[1:], len(hit)) - 1
    own = owner[hit[head]]
    base = np.cumsum(count) - count
    return keys[own], starts[own] + hit[head] - base[own], starts[own] + hit[tail] - base[own] + 1


def repeated(docs: DataFrame, window: int, mer: int, bucket_windows: int, hot_share: float, hot_least: int) -> DataFrame:
    """(k1, k2, start, end): ranges of windows (by first word) that occur elsewhere too. ``docs``: (text, k1, k2)."""
    counts = materialize(minimiser_counts(docs.select("text"), window, mer), "minimisers")
    total, windows = (x or 0 for x in counts.agg(F.sum("n"), F.sum("windows")).first())
    buckets = max(input_tasks(docs), -(-windows // bucket_windows))
    # At most 1 / hot_share minimisers hold more than that share.
    hot = np.sort(np.array([r[0] for r in counts.where(F.col("n") > max(hot_least, hot_share * total)).select("minimiser").collect()], dtype=np.int64).astype(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, CHUNK_BYTES):
                rows = list(pack_chunk(part, window, mer, shared.value, buckets))
                if rows:
                    kinds = [pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "packed", "keys", "starts", "ends"])

    def count(table: pa.Table) -> pa.Table:
        zip_ = zstandard.ZstdDecompressor()
        packed, keys, starts, out = [], [], [], []
        for row in table.to_pylist():
            key = np.frombuffer(row["keys"], dtype=np.int64).reshape(-1, 2)
            start = np.frombuffer(row["starts"], dtype="<i4").astype(np.int64)
            if row["packed"] is None:
                out.append((key, start, np.frombuffer(row["ends"], dtype="<i4").astype(np.int64)))
            else:
                packed.append(zip_.decompress(row["packed"]))
                keys.append(key)
                starts.append(start)
        if packed:
            out.append(repeated_ranges(packed, np.concatenate(keys), np.concatenate(starts), window))
        key, start, end = (np.concatenate(x) for x in zip(*out))
        return pa.table({"k1": key[:, 0], "k2": key[:, 1], "start": start, "end": end})

    rows = docs.select("text", "k1", "k2").mapInArrow(pack, PACKED)
    return rows.groupBy("bucket").applyInArrow(count, "k1 long, k2 long, start long, end long")


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    mer: int = 5,
    bucket_windows: int = 1 << 18,
    hot_share: float = 1e-6,
    hot_least: int = 1000,
) -> DataFrame:
    """(id, kept_text, n_words, n_removed) per row: words of windows that start anywhere else too are removed.

    A window is ``window`` consecutive words (unchanged, parted by ASCII white
    space) of one text; kept words are joined by one space. Shorter and null
    texts have no window. Rows with equal texts repeat each other and lose all
    windows; so do repeated rows. Null ids come back; other columns are ignored;
    an empty table gives no rows. There are as many buckets as leave each about
    ``bucket_windows`` of the counted windows; ``mer`` words make a minimiser.
    """
    text = whole_text(text_col)
    keyed = docs.select(
        text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(id_col).cast("string"), F.lit(1), text).alias("k2"), F.col(id_col).alias("id")
    )
    ranges = repeated(keyed, window, mer, bucket_windows, hot_share, hot_least)
    found = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = keyed.join(found, ["k1", "k2"], "left").select("id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, CHUNK_BYTES):
                kept, sizes, removed = [], [], []
                for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    own = t.encode().split()
                    n = len(own)
                    if r:
                        gone = np.zeros(n, dtype=bool)
                        for x in r:
                            gone[x["start"] : x["end"] + window - 1] = True
                        own = [own[i] for i in np.flatnonzero(~gone).tolist()]
                    kept.append(b" ".join(own).decode())
                    sizes.append(n)
                    removed.append(n - len(own))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["id", "kept_text", "n_words", "n_removed"])

    schema = joined.select("id").schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", id_col)
