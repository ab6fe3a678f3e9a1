"""Weights derived from frequency ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from drawlytics.operators.common import pool_window, share
from drawlytics.params import ADAPTIVE_WEIGHTS, FIB_BLEND, GAME, Game, fib
from drawlytics.plans.index import SERIES


def _fib_table(game: Game, inverse: bool) -> Column:
    values = [fib(r + 2) for r in range(max(game.main_max, game.chance_max))]
    return F.array(*[F.lit(1.0 / v if inverse else float(v)) for v in values])


def inverse_fib_weights(
    freq: DataFrame, reverse: bool = True, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, num, weight``: numbers ranked by count, rarest first unless
    ``reverse`` is off, weighted ``1 / fib(rank + 2)`` and scaled to sum 1.
    Ties keep first-encounter order (``seen_key``)."""
    w = pool_window(series_cols)
    by_count = F.asc("cnt") if reverse else F.desc("cnt")
    rank = F.row_number().over(w.orderBy(by_count, F.asc("seen_key")))
    raw = F.coalesce(F.get(_fib_table(game, True), rank - 1), F.lit(0.0))
    return (
        freq.withColumn("raw", raw)
        .withColumn("weight", share(F.col("raw"), F.sum("raw").over(w)))
        .select(*series_cols, "pool", "num", "weight")
    )


def weighted_blend(
    a: DataFrame, b: DataFrame, factor: float = FIB_BLEND, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, num, weight``: ``(1 - factor) a + factor b`` over the union of
    numbers, missing = 0. A pool present on one side only is returned as it is."""
    k = list(series_cols)
    f = max(0.0, min(1.0, factor))
    left = a.select(*k, "pool", "num", F.col("weight").alias("wa"))
    right = b.select(*k, "pool", "num", F.col("weight").alias("wb"))
    w = pool_window(k)
    both = (
        left.join(right, [*k, "pool", "num"], "full_outer")
        .withColumn("has_a", F.count("wa").over(w) > 0)
        .withColumn("has_b", F.count("wb").over(w) > 0)
    )
    mixed = F.lit(1.0 - f) * F.coalesce("wa", F.lit(0.0)) + F.lit(f) * F.coalesce("wb", F.lit(0.0))
    weight = F.when(~F.col("has_b"), F.col("wa")).when(~F.col("has_a"), F.col("wb")).otherwise(mixed)
    return both.select(*k, "pool", "num", weight.alias("weight"))


def adaptive_weights(
    freq: DataFrame,
    ratios: DataFrame | None = None,
    weights: Sequence[float] = ADAPTIVE_WEIGHTS,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, pool, num, weight``: relative frequency, inverse rank weight and
    scaled observed/expected ratio blended, then scaled to sum 1 per pool.
    ``ratios`` has ``k, pool, num, ratio``; equal ratios give ``1 / n`` each."""
    k = list(series_cols)
    total = sum(weights)
    w_freq, w_fib, w_cycle = [w if abs(total - 1.0) <= 1e-5 else w / total for w in weights]
    w = pool_window(k)
    rel = freq.select(*k, "pool", "num", share(F.col("cnt"), F.sum("cnt").over(w)).alias("f"))
    out = rel.join(
        inverse_fib_weights(freq, True, game, k).withColumnRenamed("weight", "b"), [*k, "pool", "num"], "full_outer"
    )
    if ratios is not None:
        span = F.max("ratio").over(w) - F.min("ratio").over(w)
        scaled = F.when(span > 0, (F.col("ratio") - F.min("ratio").over(w)) / F.nullif(span, F.lit(0.0))).otherwise(
            F.lit(1.0) / F.count("ratio").over(w)
        )
        out = out.join(ratios.select(*k, "pool", "num", scaled.alias("c")), [*k, "pool", "num"], "full_outer")
    else:
        out = out.withColumn("c", F.lit(0.0))
    out = out.fillna(0.0, ["f", "b", "c"]).withColumn(
        "raw", F.col("f") * w_freq + F.col("b") * w_fib + F.col("c") * w_cycle
    )
    total_raw = F.sum("raw").over(w)
    weight = F.when(total_raw > 0, F.col("raw") / F.nullif(total_raw, F.lit(0.0))).otherwise(F.col("raw"))
    return out.select(*k, "pool", "num", weight.alias("weight"))


def fib_sequence_weights(
    nums: DataFrame, max_weight: float = 1.0, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, num, weight``: numbers in ascending order weighted
    ``fib(rank + 2)``, the largest scaled to ``max_weight``."""
    w = pool_window(series_cols)
    raw = F.get(_fib_table(game, False), F.row_number().over(w.orderBy("num")) - 1)
    return (
        nums.withColumn("raw", raw)
        .withColumn("weight", F.col("raw") / F.max("raw").over(w) * F.lit(float(max_weight)))
        .select(*series_cols, "pool", "num", "weight")
    )
