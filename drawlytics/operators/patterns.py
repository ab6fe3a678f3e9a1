"""Parity, sum and consecutive-run patterns of draws.

Every pattern takes few distinct values, so draws are counted per value first
and everything else works on those bounded histograms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from drawlytics.functions.columns import nums_array
from drawlytics.params import GAME, Game
from drawlytics.plans.index import SERIES


def _with_pct(df: DataFrame, k: Sequence[str]) -> DataFrame:
    total = F.sum("cnt").over(W.partitionBy(*k))
    return df.withColumn("pct", F.col("cnt") * 100.0 / total)


def parity_dist(draws: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pattern, cnt, pct`` with patterns like ``2E-3O``."""
    even = sum((F.expr(f"CAST({c} % 2 = 0 AS INT)") for c in game.ball_cols[1:]), F.expr(f"CAST({game.ball_cols[0]} % 2 = 0 AS INT)"))
    counts = draws.groupBy(*series_cols, even.alias("even")).agg(F.count(F.lit(1)).alias("cnt"))
    pattern = F.concat(F.col("even"), F.lit("E-"), F.lit(game.main_pick) - F.col("even"), F.lit("O"))
    return _with_pct(counts, series_cols).select(*series_cols, pattern.alias("pattern"), "cnt", "pct")


def sum_histogram(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, total, cnt, first_idx``: draws per sum of numbers."""
    total = F.expr(" + ".join(game.ball_cols))
    return idx.groupBy(*series_cols, total.alias("total")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("draw_idx").alias("first_idx")
    )


def sum_stats(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, mean, median, min, max, std`` (sample std) of the draw sums."""
    n = F.sum("cnt").cast("double")
    s1 = F.sum(F.col("total") * F.col("cnt")).cast("double")
    s2 = F.sum(F.col("total") * F.col("total") * F.col("cnt")).cast("double")
    var = F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / F.nullif(n - 1.0, F.lit(0.0))
    return sum_histogram(idx, game, series_cols).groupBy(*series_cols).agg(
        (s1 / n).alias("mean"),
        F.expr("percentile(total, 0.5D, cnt)").alias("median"),
        F.min("total").alias("min"),
        F.max("total").alias("max"),
        F.sqrt(var).alias("std"),
    )


def sum_ranges(
    idx: DataFrame, buckets: int = 5, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, bucket, label, cnt, pct``: equal-width ranges of the sums, the last
    one reaching the maximum; a zero width puts everything there."""
    w = W.partitionBy(*series_cols)
    hist = sum_histogram(idx, game, series_cols).select(
        *series_cols, "total", "cnt", F.min("total").over(w).alias("lo"), F.max("total").over(w).alias("hi")
    )
    last = buckets - 1
    hist = hist.withColumn("width", F.expr(f"CAST((hi - lo) div {buckets} AS INT)")).withColumn(
        "bucket", F.expr(f"CAST(CASE WHEN width = 0 THEN {last} ELSE least({last}, (total - lo) div nullif(width, 0)) END AS INT)")
    )
    low = F.col("lo") + F.col("bucket") * F.col("width")
    high = F.when(F.col("bucket") < last, low + F.col("width") - 1).otherwise(F.col("hi"))
    counts = (
        hist.withColumn("label", F.concat(low, F.lit("-"), high))
        .groupBy(*series_cols, "bucket", "label")
        .agg(F.sum("cnt").alias("cnt"))
    )
    return _with_pct(counts, series_cols)


def top_sums(idx: DataFrame, n: int = 10, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, rnk, total, cnt``: most common sums, first seen first on ties."""
    rank = F.row_number().over(W.partitionBy(*series_cols).orderBy(F.desc("cnt"), F.asc("first_idx")))
    return (
        sum_histogram(idx, game, series_cols)
        .withColumn("rnk", rank)
        .where(F.col("rnk") <= n)
        .select(*series_cols, "rnk", "total", "cnt")
    )


def with_sorted(draws: DataFrame, game: Game = GAME) -> DataFrame:
    """Add ``s``: the numbers of the draw in ascending order."""
    return draws.withColumn("s", F.sort_array(nums_array(game)))


def _run_length_sql(i: int, game: Game) -> str:
    """How many numbers follow on from the i-th smallest, itself included."""
    if i == game.main_pick - 1:
        return "1"
    return f"(1 + CAST(s[{i + 1}] = s[{i}] + 1 AS INT) * {_run_length_sql(i + 1, game)})"


def runs_array(game: Game = GAME):
    """The maximal runs of consecutive numbers of ``s`` as
    ``array<struct<start, len>>``, null where no run starts."""
    cells = []
    for i in range(game.main_pick):
        starts = "true" if i == 0 else f"s[{i}] <> s[{i - 1}] + 1"
        cells.append(f"CASE WHEN {starts} THEN struct(s[{i}] AS start, {_run_length_sql(i, game)} AS len) END")
    return F.expr(f"array({', '.join(cells)})")


def run_length_dist(draws: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, run_len, cnt, pct``: longest run of consecutive numbers per draw."""
    longest = F.greatest(*[F.expr(_run_length_sql(i, game)) for i in range(game.main_pick)])
    counts = with_sorted(draws, game).groupBy(*series_cols, longest.alias("run_len")).agg(
        F.count(F.lit(1)).alias("cnt")
    )
    return _with_pct(counts, series_cols)


def top_runs(idx: DataFrame, n: int = 10, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, rnk, run, cnt``: most frequent maximal runs of two or more numbers,
    written ``a-b-c``; ties by first draw, then by start."""
    k = list(series_cols)
    counts = (
        with_sorted(idx.select(*k, "draw_idx", *game.ball_cols), game)
        .select(*k, "draw_idx", F.inline(runs_array(game)))
        .where("len >= 2")
        .groupBy(*k, "start", "len")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("draw_idx").alias("first_idx"))
    )
    rank = F.row_number().over(W.partitionBy(*k).orderBy(F.desc("cnt"), "first_idx", "start"))
    text = F.array_join(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1), "-")
    return (
        counts.withColumn("rnk", rank)
        .where(F.col("rnk") <= n)
        .select(*k, "rnk", text.alias("run"), "cnt")
    )
