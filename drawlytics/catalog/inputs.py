"""Inputs of the registered queries, all derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from drawlytics.functions.columns import FRENCH_MONTHS
from drawlytics.functions.sampling import with_floyd_picks
from drawlytics.operators.freq import number_freq
from drawlytics.params import GAME
from drawlytics.plans.index import domain_array, draw_index, occurrences, series_length
from drawlytics.plans.store import materialize, session_root
from drawlytics.sources.fixture import draws_from_orders, table

ALL = "all"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{session_root(spark)}/{name}-{uuid.uuid4().hex}"


def draws(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    return draws_from_orders(spark, sf_dir, series)


def idx(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    return draw_index(draws(spark, sf_dir, series))


def freq(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    return number_freq(occurrences(idx(spark, sf_dir, series)))


def ml_scores(history: DataFrame) -> DataFrame:
    """A stand-in for model output: a fixed probability per number and series."""
    p = F.when(F.col("pool") == "main", (F.col("num") * 37 % 49) / F.lit(49.0)).otherwise(
        (F.col("num") * 7 % 10) / F.lit(10.0)
    )
    return history.select("series").distinct().select("series", F.inline(domain_array())).withColumn("p", p)


def tickets(spark: SparkSession, sf_dir: str, history: DataFrame) -> DataFrame:
    """One ticket per customer: five distinct numbers keyed by the customer."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ticket_id"),
        (F.col("c_custkey") % 10 + 1).cast("int").alias("chance"),
        F.lit(ALL).alias("series"),
    )
    rows = with_floyd_picks(rows, ["'ticket'", "ticket_id"], GAME.main_max, GAME.main_pick, "md5")
    return rows.join(materialize(series_length(history), "lengths"), "series").select(
        "ticket_id",
        "series",
        (F.col("ticket_id") % F.col("n_draws")).alias("draw_idx"),
        F.array(*[f"p{i}" for i in range(1, 6)]).alias("nums"),
        "chance",
    )


def dirty(rows: DataFrame) -> DataFrame:
    """Every draw twice: as it is (``copy`` 0) and as a copy with one of seven
    defects (``copy`` 1..7, taken in turn)."""
    defects = {
        "n1": (1, "0"),
        "n2": (2, "50"),
        "n3": (3, "n2"),
        "n4": (4, "CAST(NULL AS INT)"),
        "draw_date": (7, "CAST(NULL AS DATE)"),
    }
    copies = F.array(F.lit(0), (F.col("draw_id") % 7 + 1).cast("int"))
    out = rows.withColumn("copy", F.explode(copies))
    out = out.withColumn("chance", F.expr("CASE copy WHEN 5 THEN NULL WHEN 6 THEN 11 ELSE chance END"))
    for c, (code, sql) in defects.items():
        out = out.withColumn(c, F.expr(f"CASE WHEN copy = {code} THEN {sql} ELSE {c} END"))
    return out


def date_text(rows: DataFrame) -> DataFrame:
    """Dates written in the accepted forms, by draw id."""
    months = [m for m in FRENCH_MONTHS if m not in ("fevrier", "aout", "decembre")]
    names = F.array(*[F.lit(m) for m in months])
    d = F.col("draw_date")
    french = F.concat_ws(" ", F.dayofmonth(d), F.get(names, F.month(d) - 1), F.year(d))
    text = (
        F.when(F.col("draw_id") % 11 == 0, F.lit("pas une date"))
        .when(F.col("draw_id") % 3 == 0, french)
        .when(F.col("draw_id") % 5 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("draw_id") % 7 == 0, F.concat(F.lit("lundi "), french))
        .when(F.col("draw_id") % 13 == 0, F.date_format(d, "dd-MM-yyyy"))
        .otherwise(F.date_format(d, "dd/MM/yyyy"))
    )
    return rows.withColumn("date_text", text)


def csv_history(spark: SparkSession, sf_dir: str, sep: str = ";") -> str:
    """The draws as delimited text files with the exchange header."""
    path = scratch(spark, "csv")
    rows = date_text(draws(spark, sf_dir))
    missing = F.when(F.col("draw_id") % 17 == 0, F.lit("")).otherwise(F.col("n4").cast("string"))
    rows.select(
        F.lit("").alias("Jour"),
        F.col("date_text").alias("Date"),
        F.col("n1").alias("Numéro 1"),
        F.col("n2").cast("double").alias("Numéro 2"),
        F.col("n3").alias("Numéro 3"),
        missing.alias("Numéro 4"),
        F.col("n5").alias("Numéro 5"),
        F.when(F.col("draw_id") % 19 == 0, F.lit("?")).otherwise(F.col("chance").cast("string")).alias("Chance"),
        F.col("series").alias("Historique"),
    ).write.options(header=True, sep=sep).csv(path)
    return path


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at most 32 draws in the layout the page reader expects, with
    short rows and rows holding a number out of range."""
    rows = date_text(draws(spark, sf_dir))
    n1 = F.when(F.col("draw_id") % 23 == 0, F.lit(77)).otherwise(F.col("n1"))
    chance = F.when(F.col("draw_id") % 29 == 0, F.lit("x")).otherwise(F.col("chance").cast("string"))
    cells = F.concat_ws(
        "\n",
        F.lit("<td>"), F.lit("</td>"), F.lit("<b>lundi</b>"), F.concat(F.lit("<i> "), F.col("date_text"), F.lit("</i>")),
        F.lit(""), n1, F.col("n2"), F.col("n3"), F.col("n4"), F.col("n5"), chance, F.lit("<br/>"),
    )
    row = F.when(F.col("draw_id") % 31 == 0, F.lit("<tr>\n1\n2\n</tr>")).otherwise(
        F.concat(F.lit("<tr class='d'>"), cells, F.lit("</tr>"))
    )
    return (
        rows.withColumn("row", row)
        .groupBy(F.expr("draw_id div 32").alias("page_id"))
        .agg(F.array_sort(F.collect_list(F.struct("draw_id", "row"))).alias("rows"))
        .select(
            "page_id",
            F.concat(
                F.lit("<html><body><p>tirages</p><TABLE border='1'>"),
                F.array_join("rows.row", "\n"),
                F.lit("</TABLE><table><tr>\n\na\nb\n\n1\n2\n3\n4\n5\n6\n</tr></table></body></html>"),
            ).alias("html"),
        )
    )


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game per part: pool sizes and price follow the part's columns."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("game_id"),
        (F.col("p_size") + 30).cast("int").alias("main_max"),
        F.lit(5).alias("main_pick"),
        (F.col("p_partkey") % 12 + 2).cast("int").alias("chance_max"),
        F.round(F.col("p_retailprice") / 1000, 2).alias("ticket_price"),
    )


def split_history(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new): one draw per date; new starts in the last fifth of the dates,
    overlaps the old part and holds late dates the old part lacks."""
    late = F.dayofyear("draw_date") % 50 == 0
    recent = F.col("draw_date") >= F.lit("2000-04-01").cast("date")
    overlap = F.col("draw_date") >= F.lit("2000-01-01").cast("date")
    return history.where(~late & ~recent), history.where(late | overlap)


def stored(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name)
