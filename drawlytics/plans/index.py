"""Dense chronological positions, exploded occurrences and number grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from drawlytics.params import CHANCE, GAME, MAIN, Game
from drawlytics.plans.store import materialize

SERIES = ("series",)
# First-encounter order is column-major: all of ball column 1, then column 2...
ENCOUNTER_STRIDE = 1 << 40


def draw_index(draws: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """Add ``draw_idx``, 0-based, dense per series, ordered by (draw_date, draw_id),
    and ``n_draws``, the length of the series.

    One range shuffle on (series, date, id) spreads even a single dominating
    series over all tasks; the sorted rows are written with their task number
    and position, so both are plain data from then on. The start of every
    (series, task) run is a running sum over at most one row per task. The table
    of runs is written too: Catalyst knows its size and sends it to the rows where
    it is small, else joins on (series, task), which no series makes uneven.
    """
    k = list(series_cols)
    order = [*k, "draw_date", "draw_id"]
    ranged = draws.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    )
    placed = materialize(placed, "draw-order")
    runs = placed.groupBy(*k, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = W.partitionBy(*k).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *k,
        "_part",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(W.partitionBy(*k)).alias("n_draws"),
    )
    runs = materialize(runs, "draw-runs")
    return (
        placed.join(runs, [*k, "_part"])
        .withColumn("draw_idx", F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


def series_length(idx: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    return idx.groupBy(*series_cols).agg((F.max("draw_idx") + 1).alias("n_draws"))


def with_length(idx: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``idx`` with ``n_draws``: as :func:`draw_index` left it, else joined."""
    return idx if "n_draws" in idx.columns else idx.join(series_length(idx, series_cols), list(series_cols))


def occurrences(
    idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """One row per drawn cell: ``k, draw_idx, pool, pos, num``."""
    cells = [
        F.struct(F.lit(MAIN).alias("pool"), F.lit(i).alias("pos"), F.col(c).alias("num"))
        for i, c in enumerate(game.ball_cols)
    ]
    cells.append(
        F.struct(F.lit(CHANCE).alias("pool"), F.lit(0).alias("pos"), F.col("chance").alias("num"))
    )
    return idx.select(*series_cols, "draw_idx", F.inline(F.array(*cells))).where(
        F.col("num").isNotNull()
    )


def domain_array(game: Game = GAME):
    """Every number of both pools as one constant array of structs."""
    return F.expr(
        f"concat(transform(sequence(1, {game.main_max}), x -> struct('{MAIN}' AS pool, x AS num)),"
        f" transform(sequence(1, {game.chance_max}), x -> struct('{CHANCE}' AS pool, x AS num)))"
    )


def number_grid(
    idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, n_draws, pool, num`` with one row per number of the game and series."""
    return series_length(idx, series_cols).select(
        *series_cols, "n_draws", F.inline(domain_array(game))
    )


def number_stats(occ: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """Per number: cell count, first/last position and first-encounter key."""
    return occ.groupBy(*series_cols, "pool", "num").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("draw_idx").alias("first_idx"),
        F.max("draw_idx").alias("last_idx"),
        F.min(F.col("pos") * F.lit(ENCOUNTER_STRIDE) + F.col("draw_idx")).alias("seen_key"),
    )


def number_table(
    idx: DataFrame, windows: Sequence[int] = (), game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """The written statistics of every number of the game, from one pass over the draws.

    ``k, pool, num, n_draws`` with :func:`number_stats` (count 0 and nulls if never
    drawn) and, for each of ``windows``, the same of the last ``w`` draws as
    ``cnt_w`` and ``seen_w``. What is defined per number, frequencies, gaps,
    cycles, weights and scores, reads this table instead of the draws."""
    k = [*series_cols, "n_draws"]
    rows = idx if "n_draws" in idx.columns else with_length(idx, series_cols)
    cells = occurrences(rows, game, k)
    key = F.col("pos") * F.lit(ENCOUNTER_STRIDE) + F.col("draw_idx")
    stats = [
        F.count(F.lit(1)).alias("cnt"),
        F.min("draw_idx").alias("first_idx"),
        F.max("draw_idx").alias("last_idx"),
        F.min(key).alias("seen_key"),
    ]
    for w in windows:
        inside = F.col("draw_idx") >= F.col("n_draws") - w if w > 0 else F.lit(True)
        stats += [F.count_if(inside).alias(f"cnt_{w}"), F.min(F.when(inside, key)).alias(f"seen_{w}")]
    drawn = materialize(cells.groupBy(*k, "pool", "num").agg(*stats), "drawn-numbers")
    grid = drawn.select(*k).distinct().select(*k, F.inline(domain_array(game)))
    counts = ["cnt", *(f"cnt_{w}" for w in windows)]
    return materialize(grid.join(drawn, [*k, "pool", "num"], "left").fillna(0, counts), "number-table")
