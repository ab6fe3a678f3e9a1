"""Small helpers over per-number tables (at most one row per number of the game
and series, so windows over them are bounded)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def pool_window(k: Sequence[str]) -> W:
    return W.partitionBy(*k, "pool")


def share(value: Column, total: Column) -> Column:
    """``value / total``, 0 where the total is 0."""
    return F.coalesce(value / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.0))


def min_max(df: DataFrame, col: str, k: Sequence[str]) -> DataFrame:
    """Scale ``col`` to 0..1 per series and pool; unchanged when all values agree."""
    w = pool_window(k)
    lo, span = F.min(col).over(w), F.max(col).over(w) - F.min(col).over(w)
    scaled = F.when(span > 0, (F.col(col) - lo) / F.nullif(span, F.lit(0.0))).otherwise(F.col(col))
    return df.withColumn(col, scaled)


def on_grid(grid: DataFrame, tables: Sequence[tuple[DataFrame, str]], k: Sequence[str]) -> DataFrame:
    """``grid`` (k, pool, num) left-joined with one value column of each table,
    a missing value being 0. Tables are given as (table, column)."""
    out = grid.drop(*[c for _, c in tables])
    for df, col in tables:
        out = out.join(df.select(*k, "pool", "num", col), [*k, "pool", "num"], "left")
    return out.fillna(0.0, [c for _, c in tables])
