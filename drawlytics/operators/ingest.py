"""Validation, deduplication and merging of draw histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from drawlytics.functions.columns import draw_day_after, nums_array, parse_draw_date
from drawlytics.params import GAME, Game
from drawlytics.plans.index import SERIES

# Fixed value: first draw of the current game, used when no date is known.
FIRST_DRAW = "2008-10-06"


def discover_ball_cols(columns: Sequence[str], game: Game = GAME) -> list[str]:
    """Columns whose name contains the ball marker, else the default names,
    restricted to the columns that exist."""
    found = [c for c in columns if "Numéro" in c or "numéro" in c]
    return found or [c for c in (f"Numéro {i}" for i in range(1, game.main_pick + 1)) if c in columns]


def valid_draws(draws: DataFrame, game: Game = GAME) -> DataFrame:
    """Complete rows within bounds; repeated numbers are not checked here."""
    ok = F.col("chance").between(1, game.chance_max)
    for c in game.ball_cols:
        ok = ok & F.col(c).between(1, game.main_max)
    return draws.where(ok)


def invalid_reason(nums: Column, chance: Column, date: Column | None, game: Game = GAME) -> Column:
    """First rule a submission breaks, null when it is fine."""
    known = F.filter(nums, lambda x: x.isNotNull())
    out = F.when(nums.isNull() | (F.size(known) != game.main_pick), "count")
    out = out.when(F.size(F.array_distinct(known)) != game.main_pick, "duplicate")
    out = out.when(~F.forall(known, lambda x: x.between(1, game.main_max)), "number out of range")
    out = out.when(chance.isNotNull() & ~chance.between(1, game.chance_max), "chance out of range")
    return out if date is None else out.when(date.isNull(), "date")


def validate_draws(draws: DataFrame, game: Game = GAME) -> DataFrame:
    """``draws`` plus ``is_valid, reason``. A missing chance number is allowed."""
    reason = invalid_reason(nums_array(game), F.col("chance"), F.col("draw_date"), game)
    return draws.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def split_valid(draws: DataFrame, game: Game = GAME) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with their reason)."""
    checked = validate_draws(draws, game)
    return (
        checked.where("is_valid").drop("is_valid", "reason"),
        checked.where("NOT is_valid").drop("is_valid"),
    )


def dedupe_draws(draws: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """One draw per series and date, the smallest ``draw_id``."""
    first = F.row_number().over(W.partitionBy(*series_cols, "draw_date").orderBy("draw_id"))
    return draws.withColumn("_first", first).where("_first = 1").drop("_first")


def missing_draws(a: DataFrame, b: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """Draws of ``a`` whose date is absent from ``b``."""
    keys = [*series_cols, "draw_date"]
    return a.where("draw_date IS NOT NULL").join(b.select(*keys).distinct(), keys, "left_anti")


def merge_new_draws(existing: DataFrame, new: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """The history plus the new draws whose date it lacks. Late dates are kept:
    positions come from :func:`drawlytics.plans.index.draw_index` afterwards."""
    return existing.unionByName(missing_draws(new, existing, series_cols).select(*existing.columns))


def next_draw_date(draws: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, next_date``: first Monday, Wednesday or Saturday after the last draw."""
    last = F.coalesce(F.max("draw_date"), F.lit(FIRST_DRAW).cast("date"))
    return draws.groupBy(*series_cols).agg(draw_day_after(last).alias("next_date"))


def accept_submissions(submissions: DataFrame, game: Game = GAME) -> tuple[DataFrame, DataFrame]:
    """Entries ``series, nums, chance, date_text, weekday_label`` split into
    canonical draws stamped ``submitted_at`` and rejected entries with a reason."""
    dated = submissions.withColumn("draw_date", parse_draw_date("date_text"))
    reason = invalid_reason(F.col("nums"), F.col("chance"), F.col("draw_date"), game)
    checked = dated.withColumn("reason", reason)
    good = checked.where("reason IS NULL").select(
        "series",
        F.xxhash64("series", "draw_date", "nums", "chance").alias("draw_id"),
        "draw_date",
        *[F.get("nums", F.lit(i)).alias(c) for i, c in enumerate(game.ball_cols)],
        "chance",
        F.current_timestamp().alias("submitted_at"),
    )
    return good, checked.where("reason IS NOT NULL")


def append_submitted_draws(
    submissions: DataFrame, history: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``history`` plus the valid submissions whose date it lacks, one per date,
    with ``submitted_at`` (null for older rows)."""
    good, _ = accept_submissions(submissions, game)
    fresh = dedupe_draws(missing_draws(good, history, series_cols), series_cols)
    return history.unionByName(fresh, allowMissingColumns=True)
