"""Number scores blended from frequencies, gaps, cycles, rank weights and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from drawlytics.operators.common import on_grid, pool_window, share
from drawlytics.operators.weights import inverse_fib_weights
from drawlytics.params import (
    FIB_BLEND,
    GAME,
    MAIN,
    SCORE_A_WEIGHTS,
    SCORE_B_LUNAR_WEIGHTS,
    SCORE_B_WEIGHTS,
    Game,
)
from drawlytics.plans.index import SERIES


def freq_prediction(
    freq: DataFrame, blend: float = FIB_BLEND, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, num, score`` of drawn numbers: relative frequency, in the main
    pool blended with the inverse rank weight."""
    k = list(series_cols)
    fib = inverse_fib_weights(freq, True, game, k)
    p = F.col("cnt") / F.sum("cnt").over(pool_window(k))
    both = freq.select(*k, "pool", "num", p.alias("p")).join(fib, [*k, "pool", "num"])
    score = F.when(
        F.col("pool") == MAIN, F.lit(1 - blend) * F.col("p") + F.lit(blend) * F.col("weight")
    ).otherwise(F.col("p"))
    return both.select(*k, "pool", "num", score.alias("score"))


def _of_max(col: str, k: Sequence[str]) -> Column:
    return share(F.col(col), F.max(col).over(pool_window(k)))


def score_a(
    grid: DataFrame,
    pred: DataFrame,
    gap: DataFrame,
    freq: DataFrame,
    weights: Sequence[float] = SCORE_A_WEIGHTS,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, pool, num, score`` for every number: prediction, gap and frequency,
    the last two relative to their maximum."""
    k = list(series_cols)
    full = on_grid(
        grid,
        [
            (pred.withColumnRenamed("score", "pred"), "pred"),
            (gap.withColumnRenamed("score", "gap"), "gap"),
            (freq, "cnt"),
        ],
        k,
    )
    w_pred, w_gap, w_freq = weights
    score = w_pred * F.col("pred") + w_gap * _of_max("gap", k) + w_freq * _of_max("cnt", k)
    return full.select(*k, "pool", "num", score.alias("score"))


def score_b(
    grid: DataFrame,
    freq: DataFrame,
    gap: DataFrame,
    ml: DataFrame | None = None,
    cycle: DataFrame | None = None,
    lunar: bool = False,
    fib: DataFrame | None = None,
    blend: float = FIB_BLEND,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, pool, num, score``: frequency, mean gap, model probability and cycle
    weight; ``lunar`` shifts the weights towards the cycle part. ``fib`` weights
    are blended in last, only for numbers that have one."""
    k = list(series_cols)
    w = SCORE_B_LUNAR_WEIGHTS if lunar else SCORE_B_WEIGHTS
    tables = [(freq, "cnt"), (gap.withColumnRenamed("score", "gap"), "gap")]
    if ml is not None:
        tables.append((ml.select(*k, "pool", "num", F.col("p").alias("ml")), "ml"))
    if cycle is not None:
        tables.append((cycle.withColumnRenamed("weight", "cycle"), "cycle"))
    full = on_grid(grid, tables, k)
    score = w["freq"] * _of_max("cnt", k) + w["gap"] * _of_max("gap", k)
    if ml is not None:
        score = score + w["ml"] * F.col("ml")
    if cycle is not None:
        score = score + w["cycle"] * F.col("cycle")
    out = full.select(*k, "pool", "num", score.alias("score"))
    if fib is None:
        return out
    mixed = F.when(
        F.col("weight").isNotNull(), F.lit(1 - blend) * F.col("score") + F.lit(blend) * F.col("weight")
    ).otherwise(F.col("score"))
    return out.join(fib.select(*k, "pool", "num", "weight"), [*k, "pool", "num"], "left").select(
        *k, "pool", "num", mixed.alias("score")
    )


def blend(
    grid: DataFrame,
    parts: Sequence[tuple[DataFrame, str, float]],
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, pool, num, score``: weighted sum of (table, value column, weight)
    over every number, missing values being 0."""
    k = list(series_cols)
    named = [
        (df.select(*k, "pool", "num", F.col(col).cast("double").alias(f"part{i}")), f"part{i}")
        for i, (df, col, _) in enumerate(parts)
    ]
    score = sum((F.lit(w) * F.col(f"part{i}") for i, (_, _, w) in enumerate(parts)), F.lit(0.0))
    return on_grid(grid, named, k).select(*k, "pool", "num", score.alias("score"))


def blend_fibonacci(grid, ml, fib, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """70 % model, 30 % inverse rank weight."""
    return blend(grid, [(ml, "p", 0.7), (fib, "weight", 0.3)], series_cols)


def blend_cycle(grid, ml, cycle, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """60 % model, 40 % cycle weight."""
    return blend(grid, [(ml, "p", 0.6), (cycle, "weight", 0.4)], series_cols)


def blend_optimized(grid, ml, fib, cycle, freq, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """35 % model, 25 % rank weight, 25 % cycle weight, 15 % relative frequency."""
    return blend(
        grid, [(ml, "p", 0.35), (fib, "weight", 0.25), (cycle, "weight", 0.25), (freq, "rel", 0.15)], series_cols
    )


def rank_scores(scores: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """Add ``rnk``: 1 = best score, smaller number first on ties. Scores are
    compared at 12 decimals, so summation order cannot decide a rank."""
    w = pool_window(series_cols).orderBy(F.round("score", 12).desc(), F.asc("num"))
    return scores.withColumn("rnk", F.row_number().over(w))


def rank_numbers(scores: DataFrame, n: int = 5, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, nums``: the ``n`` best numbers of each pool in ascending order."""
    return (
        rank_scores(scores, series_cols)
        .where(F.col("rnk") <= n)
        .groupBy(*series_cols, "pool")
        .agg(F.array_sort(F.collect_list("num")).alias("nums"))
    )
