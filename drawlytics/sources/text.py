"""Draw histories from delimited text and from stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from drawlytics.functions.columns import parse_draw_date, whole_number
from drawlytics.operators.ingest import discover_ball_cols
from drawlytics.params import GAME, Game

DATE_COL, DAY_COL, CHANCE_COL = "Date", "Jour", "Chance"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``,`` or ``;``, whichever splits the header line into more columns."""
    header = spark.read.text(path).limit(1).collect()
    line = header[0][0] if header else ""
    return max((",", ";"), key=line.count)


def read_draws_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    series: str = "all",
    series_col: str | None = None,
    game: Game = GAME,
) -> DataFrame:
    """Canonical draws of a delimited history. Rows without a readable date or
    with a missing ball are dropped; the chance number may be missing. All
    parsing is column expressions on the scan.

    ``draw_id`` is a hash of the row content, so equal inputs give equal ids."""
    raw = spark.read.options(header=True, sep=sep or sniff_separator(spark, path), mode="PERMISSIVE").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    balls = discover_ball_cols(raw.columns, game)
    if DATE_COL not in raw.columns:
        raise ValueError(f"no column {DATE_COL!r} in {raw.columns}")
    if len(balls) != game.main_pick:
        raise ValueError(f"expected {game.main_pick} ball columns, found {balls}")
    absent = F.lit(None).cast("string")
    out = raw.select(
        (F.col(series_col) if series_col else F.lit(series)).alias("series"),
        parse_draw_date(f"`{DATE_COL}`").alias("draw_date"),
        (F.col(DAY_COL) if DAY_COL in raw.columns else absent).alias("weekday_label"),
        *[whole_number(f"`{b}`").alias(c) for b, c in zip(balls, game.ball_cols)],
        (whole_number(CHANCE_COL) if CHANCE_COL in raw.columns else absent.cast("int")).alias("chance"),
    ).dropna(subset=["draw_date", *game.ball_cols])
    return out.withColumn("draw_id", F.xxhash64("series", "draw_date", *game.ball_cols, "chance"))


# Entities that occur in French page text.
ENTITIES = {
    "&nbsp;": " ", "&eacute;": "é", "&ucirc;": "û", "&Eacute;": "É", "&quot;": '"',
    "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}


def _text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]+>", "")
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def extract_draw_rows(pages: DataFrame, html_col: str = "html", game: Game = GAME) -> DataFrame:
    """``page_id, row_no, weekday_label, draw_date, n1.., chance`` from the first
    table of every page.

    The text of a row is read line by line: day at 2, date at 3, numbers from 5,
    chance right after them. Rows that are too short or hold a number out of
    range are dropped; an unusable chance number is null."""
    table = F.regexp_extract(html_col, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    first = 5
    chance_at = first + game.main_pick
    lines = F.split(_text(F.col("row")), "\n")
    number = {
        c: F.trim(F.col("parts")[first + i]).try_cast("int") for i, c in enumerate(game.ball_cols)
    }
    bonus = F.trim(F.col("parts")[chance_at]).try_cast("int")
    out = (
        pages.select("page_id", F.posexplode(rows).alias("row_no", "row"))
        .select("page_id", "row_no", lines.alias("parts"))
        .where(F.size("parts") > chance_at)
        .select(
            "page_id",
            "row_no",
            F.trim(F.col("parts")[2]).alias("weekday_label"),
            parse_draw_date(F.col("parts")[3]).alias("draw_date"),
            *[v.alias(c) for c, v in number.items()],
            F.when(bonus.between(1, game.chance_max), bonus).alias("chance"),
        )
    )
    ok = F.lit(True)
    for c in game.ball_cols:
        ok = ok & F.col(c).between(1, game.main_max)
    return out.where(ok)
