"""Versioned draw histories and report sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drawlytics.operators.ingest import dedupe_draws, missing_draws
from drawlytics.plans.index import SERIES
from drawlytics.plans.store import materialize
from drawlytics.sources import versioned
from drawlytics.sources.versioned import versions  # noqa: F401


def month(date: Column | str = "draw_date") -> Column:
    """The partition of a date: year and month as a number, 0 for none."""
    d = F.col(date) if isinstance(date, str) else date
    return F.coalesce(F.year(d) * 100 + F.month(d), F.lit(0)).cast("int")


def write_history(draws: DataFrame, base: str) -> int:
    """Write a whole new version and return its number. Older versions stay; an
    empty result is refused. A version counts once it is published."""
    version = versioned.publish(draws.withColumn("part", month()), base, whole=True)
    if version is None:
        raise ValueError("refusing to write an empty history")
    return version


def merge_history(new: DataFrame, base: str, series_cols: Sequence[str] = SERIES) -> int | None:
    """Publish a version with the draws of ``new`` whose date the history lacks, one
    per series and date; None if there are none.

    Only the months of those draws are read and written again: the driver
    gets the months of ``new``, every other month stays where it is.
    """
    spark = new.sparkSession
    fresh = materialize(dedupe_draws(new.where("draw_date IS NOT NULL"), series_cols).withColumn("part", month()), "fresh-draws")

    def touched(rows: DataFrame) -> list[int]:
        return [r["part"] for r in rows.select("part").distinct().collect()]

    seen = versioned.read(spark, base, only=touched(fresh))
    if seen is not None:
        fresh = materialize(missing_draws(fresh, seen, series_cols), "missing-draws")
    months = touched(fresh)
    if not months:
        return None
    kept = versioned.read(spark, base, only=months)
    merged = fresh if kept is None else kept.withColumn("part", month()).unionByName(fresh.select(*kept.columns, "part"))
    return versioned.publish(merged, base)


def history_versions(spark: SparkSession, base: str) -> list[int]:
    return versioned.published(spark, base)


def read_history(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    if version is not None and version not in history_versions(spark, base):
        raise FileNotFoundError(f"no version {version} under {base}")
    out = versioned.read(spark, base, version)
    if out is None:
        raise FileNotFoundError(f"no complete history under {base}")
    return out


def write_draws_csv(draws: DataFrame, path: str, sep: str = ",") -> None:
    """The delimited exchange format: day, ``dd/MM/yyyy`` date, numbers, chance."""
    balls = [c for c in draws.columns if re.fullmatch(r"n\d+", c)]
    label = F.col("weekday_label") if "weekday_label" in draws.columns else F.date_format("draw_date", "EEEE")
    draws.select(
        label.alias("Jour"),
        F.date_format("draw_date", "dd/MM/yyyy").alias("Date"),
        *[F.col(c).alias(f"Numéro {c[1:]}") for c in balls],
        F.col("chance").alias("Chance"),
    ).write.options(header=True, sep=sep).mode("overwrite").csv(path)


def write_report_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
