"""URL filters: rules first, then an exact membership test by a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from drawlytics.llm.common import ascii_lower, mixed, shared
from drawlytics.plans.store import materialize

P = "_url_"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, the earlier of equal ones; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(str(r))):
        out = F.when(rule.fits(host, path), F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(keys, hashes) bit numbers of a level."""
    a = mixed(h1 + np.uint64(2 * level + 1))
    b = mixed(h2 + np.uint64(2 * level + 2)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)], axis=1).astype(np.int64)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def holds(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = _places(h1, h2, level, self.bits, self.hashes)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


class Cascade:
    """Levels in turn hold the listed keys, those others that the level before takes for listed, and so on."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        out = np.zeros(len(h1), dtype=bool)
        left = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            out[left] = i % 2 == 1
            left = left[level.holds(h1[left], h2[left], i)]
            out[left] = i % 2 == 0
        return out


def _longs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(P + c)).to_numpy().view(np.uint64) for c in ("h1", "h2"))


def with_keys(df: DataFrame, key: Column) -> DataFrame:
    """Adds the two 64-bit hashes that stand for a key."""
    return df.withColumn(f"{P}h1", F.xxhash64(key)).withColumn(f"{P}h2", F.xxhash64(F.lit(1), key))


def _level(keys: DataFrame, number: int, n: int, bits_per_key: int, hashes: int) -> Level:
    """A Bloom filter of ``keys``, folded by 64-bit word; at most ``bits / 64`` rows reach the driver."""
    bits = max(64, n * bits_per_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(*_longs(batch), number, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    rows = keys.select(f"{P}h1", f"{P}h2").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(bits // 64 + 1, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("value").to_numpy().view(np.uint64)
    return Level(bits, hashes, words)


def _taken(keys: DataFrame, level: Level, number: int) -> DataFrame:
    """The keys that a level holds."""
    held = shared(keys.sparkSession, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        for batch in batches:
            yield batch.filter(pa.array(own.holds(*_longs(batch), number)))

    return keys.mapInArrow(run, keys.schema)


def build(universe: DataFrame, bits_per_key: int = 10, hashes: int = 7) -> Cascade:
    """A cascade over ``universe``: different keys (_url_h1, _url_h2) and whether each is ``listed``.

    Levels are added until one takes no key of the other kind. False positives
    are few per level, so the sets and the filters shrink by about a hundred each.
    """
    out = Cascade()
    own, other = (materialize(universe.where(c).select(f"{P}h1", f"{P}h2"), "keys") for c in ("listed", "NOT listed"))
    n = own.count()
    while n:
        number = len(out.levels)
        level = _level(own, number, n, bits_per_key, hashes)
        out.levels.append(level)
        wrong = materialize(_taken(other, level, number), "keys")
        own, other, n = wrong, own, wrong.count()
    return out


def with_listed(rows: DataFrame, universe: DataFrame, shard_keys: int = 5_000_000) -> DataFrame:
    """``rows`` (with _url_h1, _url_h2) plus ``_url_listed``.

    ``universe``: (_url_h1, _url_h2, listed), every key of ``rows`` once. One
    cascade holds about ``shard_keys`` listed keys (6 MB at 10 bits each) and is
    broadcast; a longer list is cut by key hash, each part with a pass over its
    own rows. Rows are never joined or shuffled.
    """
    spark = rows.sparkSession
    stored = materialize(universe, "universe")
    n = stored.where("listed").count()
    shards = max(1, math.ceil(n / shard_keys))
    part = F.pmod(F.xxhash64(f"{P}h1", F.lit(7)), F.lit(shards))
    schema = StructType([*rows.schema.fields, StructField(f"{P}listed", BooleanType())])
    out = None
    for k in range(shards):
        held = shared(spark, build(stored.where(part == k)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            cascade = held()
            for batch in batches:
                found = pa.array(cascade.listed(*_longs(batch)), pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

        own = rows.where(part == k).mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out


def judged(pages: DataFrame, rules: Sequence[Rule], listed: Column, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row.

    ``listed`` says of ``host`` whether it is on the block list; the list and its
    complement over all hosts of ``pages`` are compiled into the cascade, which
    then judges every url no rule fits. Null urls and urls without ``://`` have
    an empty host, judged like any other. Repeated rows and null ids come back;
    other columns are ignored; an empty table gives no rows.
    """
    host, path = split_url(url_col)
    rows = with_keys(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), F.col("host"))
    universe = rows.groupBy(f"{P}h1", f"{P}h2").agg(F.any_value("host").alias("host")).select(f"{P}h1", f"{P}h2", listed.alias("listed"))
    rule = rule_of(rules, F.col("host"), F.col("path"))
    known = with_listed(rows, universe).withColumn(f"{P}rule", rule)
    verdict = F.coalesce(f"{P}rule.verdict", F.when(F.col(f"{P}listed"), "block").otherwise("allow"))
    return known.select(id_col, "host", "path", F.col(f"{P}rule.rule").alias("rule"), verdict.alias("verdict"))
