"""Equi-joins in which a few keys may own a large share of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from drawlytics.plans.store import materialize

#: Keys that may count as hot: what is broadcast has at most so many rows.
MOST_HOT = 100_000


def join_hot(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    part_rows: int = 1_000_000,
) -> DataFrame:
    """``left`` join ``right`` on ``keys``, with ``right`` unique per key.

    A key with more than a part's left rows is spread over as many parts as its
    rows fill; only its right row is repeated, once per part. A part holds
    ``part_rows`` or, in a very large table, a 100 000th of all rows, so fewer
    than 100 000 keys are ever spread and their list can be broadcast. Catalyst
    judges an exploded side by the table it came from and would send it to the
    driver whole; over a part's rows, both sides are sorted instead.
    """
    k = list(keys)
    counts = materialize(left.groupBy(*k).agg(F.count(F.lit(1)).alias("_rows")), "key-rows")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    size = max(part_rows, -(-total // MOST_HOT))
    parts = F.floor(F.col("_rows") / F.lit(size)) + 1
    hot = F.broadcast(counts.where(F.col("_rows") > size).select(*k, parts.alias("_parts")))
    of = F.coalesce("_parts", F.lit(1))
    spread = left.join(hot, k, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), of)).drop("_parts")
    copies = right.join(hot, k, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), of - 1))).drop("_parts")
    copies = copies.hint("merge") if total > part_rows else copies
    return spread.join(copies, [*k, "_part"], how).drop("_part")
