"""What several operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, as Java and RE2 regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


def whole_text(text: str | Column) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one row at least."""
    _, offsets = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the n + 1 bounds of each text's words."""
    inside = ~separator[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(data) else np.empty(0, dtype=np.int64)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts)
    # A text ends its last word, even where the next text goes on without a separator.
    joined = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    first = change[inside[change]] if len(change) else change
    last = change[~inside[change]] if len(change) else change
    starts = [first, joined]
    ends = [last, joined]
    if len(data) and inside[0]:
        starts.append(np.zeros(1, dtype=np.int64))
    if len(data) and inside[-1]:
        ends.append(np.array([len(data)]))
    starts, ends = np.sort(np.concatenate(starts)), np.sort(np.concatenate(ends))
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for every size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every byte span (none empty): mixed bytes summed with powers of an odd base."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * MIX + np.uint64(seed))
    size = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    total = np.cumsum(size)
    power = powers(0xD6E8FEB86659FD93, int(size.max(initial=0)))
    first = 0
    while first < len(starts):
        # About a megabyte at a time, one span at least.
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + (1 << 20), "right")))
        own = size[first:last]
        shift = ragged(own)
        value = table[data[np.repeat(starts[first:last], own) + shift]] * power[shift]
        out[first:last] = np.add.reduceat(value, np.cumsum(own) - own)
        first = last
    return mixed(out ^ size.astype(np.uint64))


def input_tasks(df: DataFrame, least: int = 8) -> int:
    """Shuffle partitions of the session, as the number of parts of explicit shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcasts ``value``, of a class of this package too; what comes back reads it in a task.

    Broadcasts are pickled by reference; these bytes hold the class, so workers need no copy of the package.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
