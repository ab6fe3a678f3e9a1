"""Distances between successive appearances of a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from drawlytics.params import BLOCK, CHANCE, GAME, MAIN, Game
from drawlytics.plans.blocks import block_carry, block_of, by_block
from drawlytics.plans.index import SERIES, number_grid, number_stats, occurrences, with_length


def _appearances(
    idx: DataFrame, game: Game, k: list[str], block: int
) -> DataFrame:
    """``k, pool, num, draw_idx, prev``: distinct appearances with the previous
    one. Draws are shuffled once by block; exploding, sorting and ``lag`` stay
    inside the block and its first appearances take the carried position."""
    carry = block_carry(idx, ["last"], game, k, block)
    rows = by_block(idx.select(*k, "draw_idx", *game.ball_cols, "chance").withColumn("blk", block_of(block)), k)
    rows = rows.join(carry.withColumnRenamed("last", "entry"), [*k, "blk"])
    # A number repeated inside a draw appears once: the later cell becomes null.
    # Chance numbers take the slots behind the main pool.
    cells = []
    for i, c in enumerate(game.ball_cols):
        repeated = f"{c} IN ({', '.join(game.ball_cols[:i])})" if i else "false"
        cells.append(F.expr(f"CASE WHEN {repeated} THEN NULL ELSE {c} END"))
    cells.append(F.col("chance") + game.main_max)
    occ = (
        rows.select(*k, "blk", "draw_idx", "entry", F.explode(F.array(*cells)).alias("slot"))
        .where("slot IS NOT NULL")
        .withColumn("entry", F.get("entry", F.col("slot") - 1))
    )
    # One long leads the sort order, so that rows rarely compare beyond it.
    occ = occ.withColumn("run", F.col("blk") * F.lit(1 << 16) + F.col("slot"))
    before = F.lag("draw_idx").over(W.partitionBy("run", *k, "blk").orderBy("draw_idx"))
    carried = F.when(F.col("entry") >= 0, F.col("entry"))
    main = F.col("slot") <= game.main_max
    return occ.select(
        *k,
        F.when(main, MAIN).otherwise(CHANCE).alias("pool"),
        F.when(main, F.col("slot")).otherwise(F.col("slot") - game.main_max).alias("num"),
        "draw_idx",
        F.coalesce(before, carried).alias("prev"),
    )


def gap_history(
    idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES, block: int = BLOCK
) -> DataFrame:
    """``k, pool, num, draw_idx, gap``: draws skipped since the last appearance."""
    k = list(series_cols)
    return (
        _appearances(idx, game, k, block)
        .where("prev IS NOT NULL")
        .select(*k, "pool", "num", "draw_idx", (F.col("draw_idx") - F.col("prev") - 1).alias("gap"))
    )


def gap_stats(
    gaps: DataFrame, grid: DataFrame, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, pool, num, mean, median, max, min, std, cnt`` (population std) of a
    :func:`gap_history`; nulls and count 0 for a number without gaps. Gaps are
    counted per value map-side before the exact median is taken."""
    k = list(series_cols)
    per_gap = gaps.groupBy(*k, "pool", "num", "gap").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").cast("double")
    s1 = F.sum(F.col("gap") * F.col("c")).cast("double")
    s2 = F.sum(F.col("gap") * F.col("gap") * F.col("c")).cast("double")
    stats = per_gap.groupBy(*k, "pool", "num").agg(
        (s1 / n).alias("mean"),
        F.expr("percentile(gap, 0.5D, c)").alias("median"),
        F.max("gap").alias("max"),
        F.min("gap").alias("min"),
        F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))).alias("std"),
        F.sum("c").alias("cnt"),
    )
    return grid.select(*k, "pool", "num").join(stats, [*k, "pool", "num"], "left").fillna(0, ["cnt"])


def returns_stats(gaps: DataFrame, grid: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """Another name for :func:`gap_stats`."""
    return gap_stats(gaps, grid, series_cols)


def _current(idx: DataFrame, game: Game, k: Sequence[str]) -> DataFrame:
    stats = number_stats(occurrences(idx, game, k), k)
    return number_grid(idx, game, k).join(stats, [*k, "pool", "num"], "left")


def current_gap_of(table: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """:func:`current_gap` from a number table."""
    gap = F.coalesce(F.col("n_draws") - 1 - F.col("last_idx"), F.col("n_draws"))
    return table.select(*series_cols, "pool", "num", gap.alias("gap"))


def gap_score_current_of(table: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """:func:`gap_score_current` from a number table."""
    score = F.col("n_draws") - 1 - F.col("last_idx")
    return table.where("last_idx IS NOT NULL").select(*series_cols, "pool", "num", score.cast("double").alias("score"))


def gap_score_mean_of(table: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """:func:`gap_score_mean` from a number table."""
    mean = (F.col("n_draws") - 1 - F.col("first_idx")) / F.nullif("cnt", F.lit(0))
    score = F.coalesce(mean, F.col("n_draws").cast("double"))
    return table.select(*series_cols, "pool", "num", score.alias("score"))


def current_gap(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, gap``: draws since the last appearance, the history length
    for a number never drawn."""
    return current_gap_of(_current(idx, game, series_cols), series_cols)


def gap_score_current(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, score``: the current gap; numbers never drawn have no row."""
    return gap_score_current_of(_current(idx, game, series_cols), series_cols)


def gap_score_mean(idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, score``: mean distance over all appearances, the open tail
    included. The distances telescope to ``(N - 1 - first) / appearances``;
    never drawn gives the history length."""
    return gap_score_mean_of(_current(idx, game, series_cols), series_cols)


def gaps_at_draw(
    idx: DataFrame, at: int, game: Game = GAME, series_cols: Sequence[str] = SERIES, block: int = BLOCK
) -> DataFrame:
    """``k, pool, num, seq, gap``: the gaps of each number as known at draw
    ``at``, the open tail ``at - last`` being the last entry.

    The list order is the order of appearance; ``seq`` is the position of the
    closing draw (``at`` plus one for the tail)."""
    k = list(series_cols)
    seen = with_length(idx, k).where((F.col("draw_idx") <= at) & (F.col("n_draws") > at)).drop("n_draws")
    closed = gap_history(seen, game, k, block).withColumnRenamed("draw_idx", "seq")
    tail = number_stats(occurrences(seen, game, k), k).select(
        *k, "pool", "num", F.lit(at + 1).cast("bigint").alias("seq"), (F.lit(at) - F.col("last_idx")).alias("gap")
    )
    return closed.unionByName(tail)
