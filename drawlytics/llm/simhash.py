"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from drawlytics.llm.common import whole_text
from drawlytics.llm.graph import components
from drawlytics.plans.store import materialize

PRINT = "_simhash"
#: Shingle hashes expanded to bits at once.
CHUNK = 1 << 16


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """Signed 64-bit SimHash of a text; zero without words."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        grams = [b" ".join(found)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = ends - 1 - np.fromiter(map(len, found), np.int64, len(found))
        grams = [joined[s:e] for s, e in zip(starts[: len(found) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=">u8", count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with the long column ``_simhash``; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            prints = pa.array([fingerprint(t.as_py() or "", shingle, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, PRINT])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(PRINT, LongType())]))


def masks(blocks: int, distance: int) -> list[int]:
    """Signed bit masks of every choice of ``blocks - distance`` of the blocks of 64 bits."""
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    found = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def close_pairs(prints: DataFrame, distance: int = 2, blocks: int = 6) -> DataFrame:
    """Pairs (a, b) of different values of ``prints._simhash`` (distinct) at most ``distance`` bits apart.

    Of ``blocks`` blocks at least ``blocks - distance`` agree for a close pair:
    one table per choice of so many blocks, joined on their bits (42 at the
    defaults), then verified.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(PRINT).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(blocks, distance))])
    rows = prints.select(PRINT, F.inline(keys))
    left, right = rows.alias("l"), rows.alias("r")
    near = (F.col(f"l.{PRINT}") < F.col(f"r.{PRINT}")) & (hamming(F.col(f"l.{PRINT}"), F.col(f"r.{PRINT}")) <= distance)
    same = (F.col("l.t") == F.col("r.t")) & (F.col("l.k") == F.col("r.k"))
    return left.join(right, same & near).select(F.col(f"l.{PRINT}").alias("a"), F.col(f"r.{PRINT}").alias("b")).distinct()


def classes(rows: DataFrame, rep: Column, distance: int = 2, blocks: int = 6) -> DataFrame:
    """(_simhash, rep): the smallest ``rep`` of all rows whose fingerprints are linked.

    Rows of one fingerprint are one class, counted map-side, so a group of
    equal texts is one value in the join and in the graph.
    """
    own = materialize(rows.groupBy(PRINT).agg(F.min(rep).alias("rep")), "prints")
    roots = materialize(components(close_pairs(own.select(PRINT), distance, blocks)), "roots")
    linked = roots.select(F.col("node").alias(PRINT), "root").unionByName(
        roots.select(F.col("root").alias(PRINT), "root").distinct()
    )
    linked = materialize(own.join(linked, PRINT), "linked")
    best = materialize(linked.groupBy("root").agg(F.min("rep").alias("rep")), "best")
    return materialize(
        own.join(linked, PRINT, "left_anti").unionByName(linked.drop("rep").join(best, "root").select(PRINT, "rep")),
        "classes",
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 6
) -> DataFrame:
    """(id, fingerprint, component_id) per row of ``docs``.

    Texts without a word have fingerprint zero and link like any other. Rows
    with the same id and rows with equal texts all come back; a null id never
    names a component unless all its ids are null. Other columns are ignored; an
    empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    prints = materialize(with_fingerprint(slim, "text", shingle).select("id", PRINT), "fingerprints")
    found = classes(prints, F.col("id"), distance, blocks)
    return prints.join(found, PRINT).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex(PRINT)), 16, "0").alias("fingerprint"),
        F.col("rep").alias("component_id"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, blocks: int = 6) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, null ids last, repeated rows once."""
    columns = docs.columns
    row = "_simhash_row"
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rep = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    # Python sees the texts but does not hand them back.
    slim = kept.select(rep.alias("rep"), whole_text(text_col).alias("text"))
    slim = materialize(with_fingerprint(slim, "text", shingle).select(PRINT, "rep"), "fingerprints")
    # Most rows stay: the others are the smaller side, and the texts need no shuffle while that side is small.
    others = slim.join(classes(slim, F.col("rep"), distance, blocks).select(PRINT, F.col("rep.row").alias("first")), PRINT)
    others = materialize(others.where(F.col("rep.row") != F.col("first")).select(F.col("rep.row").alias(row)), "others")
    return kept.join(others, row, "left_anti").select(*columns)
