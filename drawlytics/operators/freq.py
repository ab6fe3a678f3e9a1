"""How often numbers are drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from drawlytics.operators.common import on_grid, pool_window
from drawlytics.params import ANALYSIS_WINDOW, GAME, MAIN, N_COLD, N_HOT, Game
from drawlytics.plans.index import SERIES, number_grid, number_stats, occurrences, with_length


def number_freq(occ: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, cnt, rel, seen_key`` for drawn numbers only. ``rel`` is the
    share of all cells of the pool; ``seen_key`` orders numbers by first encounter."""
    total = F.sum("cnt").over(pool_window(series_cols))
    return number_stats(occ, series_cols).select(
        *series_cols, "pool", "num", "cnt", (F.col("cnt") / total).alias("rel"), "seen_key"
    )


def freq_of(table: DataFrame, window: int | None = None, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """:func:`number_freq`, or :func:`window_freq` of one of its windows, from a number table."""
    cnt, seen = ("cnt", "seen_key") if window is None else (f"cnt_{window}", f"seen_{window}")
    drawn = table.where(F.col(cnt) > 0)
    total = F.sum(cnt).over(pool_window(series_cols))
    return drawn.select(
        *series_cols, "pool", "num", F.col(cnt).alias("cnt"), (F.col(cnt) / total).alias("rel"), F.col(seen).alias("seen_key")
    )


def number_freq_filled(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, n_draws, pool, num, cnt`` for every number of the game."""
    counts = occurrences(idx, game, series_cols).groupBy(*series_cols, "pool", "num").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return on_grid(number_grid(idx, game, series_cols), [(counts, "cnt")], series_cols)


def last_draws(idx: DataFrame, window: int, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """The last ``min(window, N)`` draws of every series."""
    return with_length(idx, series_cols).where(F.col("draw_idx") >= F.col("n_draws") - window).drop("n_draws")


def window_freq(
    idx: DataFrame,
    window: int = ANALYSIS_WINDOW,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """:func:`number_freq` over the last ``window`` draws."""
    return number_freq(occurrences(last_draws(idx, window, series_cols), game, series_cols), series_cols)


def hot_cold(
    freq: DataFrame, n_hot: int = N_HOT, n_cold: int = N_COLD, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, kind, rnk, num, cnt``: most and least frequent drawn numbers.
    Ties: hot first encountered first, cold last encountered first."""
    w = pool_window(series_cols)
    hot = F.row_number().over(w.orderBy(F.desc("cnt"), F.asc("seen_key")))
    cold = F.row_number().over(w.orderBy(F.asc("cnt"), F.desc("seen_key")))
    kinds = F.array(
        F.struct(F.lit("hot").alias("kind"), F.col("hot").alias("rnk"), F.lit(n_hot).alias("top")),
        F.struct(F.lit("cold").alias("kind"), F.col("cold").alias("rnk"), F.lit(n_cold).alias("top")),
    )
    return (
        freq.withColumn("hot", hot)
        .withColumn("cold", cold)
        .select(*series_cols, "pool", "num", "cnt", F.inline(kinds))
        .where("rnk <= top")
        .select(*series_cols, "pool", "kind", "rnk", "num", "cnt")
    )


def top_freq(freq: DataFrame, n: int, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, rnk, num, cnt``: the ``n`` most frequent numbers per pool."""
    rank = F.row_number().over(pool_window(series_cols).orderBy(F.desc("cnt"), F.asc("seen_key")))
    return (
        freq.withColumn("rnk", rank)
        .where(F.col("rnk") <= n)
        .select(*series_cols, "pool", "rnk", "num", "cnt")
    )


def number_report(
    grid: DataFrame,
    freq: DataFrame,
    scores: DataFrame,
    gaps: DataFrame,
    hotcold: DataFrame,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, num, cnt, score, gap, status`` per main number; status is ``Chaud``
    or ``Froid`` for hot or cold numbers (hot wins), else empty."""
    k = list(series_cols)
    marks = hotcold.groupBy(*k, "pool", "num").agg(
        F.max(F.when(F.col("kind") == "hot", 2).otherwise(1)).alias("mark")
    )
    out = on_grid(
        grid.where(F.col("pool") == MAIN), [(freq, "cnt"), (scores, "score"), (gaps, "gap"), (marks, "mark")], k
    )
    status = F.when(F.col("mark") == 2, "Chaud").when(F.col("mark") == 1, "Froid").otherwise("")
    return out.select(*k, "num", "cnt", "score", "gap", status.alias("status"))
