"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlytics.llm.common import SPACES, whole_text
from drawlytics.plans.store import materialize

HOST, KEYS, SETS = "_line_host", "_line_keys", "_line_sets"
BLANK = rf"^({SPACES})?$"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 hash bits of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def _has_word(line: Column) -> Column:
    return ~line.rlike(BLANK)


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, keys): hashes of the lines on over ``ratio`` of a host's pages and on ``min_pages`` or more.

    A page counts a line once. Counts are folded map-side, so a host with a
    third of all pages is never one group; what is left per host is bounded by
    lines per page / ``ratio``.
    """
    pages = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias(HOST), whole_text(text_col).alias("text"))
    totals = materialize(pages.groupBy(HOST).agg(F.count(F.lit(1)).alias("pages")), "hosts")
    seen = pages.select(HOST, F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), _key))).alias("key"))
    counts = seen.groupBy(HOST, "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    often = counts.join(totals, HOST).where(F.col("n") > ratio * F.col("pages"))
    return materialize(often.groupBy(HOST).agg(F.collect_list("key").alias(SETS)), "boilerplate")


def drop_boilerplate(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = 0.05,
    min_pages: int = 5,
    counts: bool = False,
) -> DataFrame:
    """``docs`` without the lines found on over ``ratio`` of their host's pages.

    Lines are split at ``\\n`` and compared whole; blank lines are never counted
    or dropped. A page all of whose lines would go is a copy rather than
    boilerplate and stays as it is. A null host shares the group of the empty
    name; a null text stays null; repeated rows are pages of their own. With
    ``counts``, adds ``n_lines`` (not blank) and ``n_dropped``. An empty table
    stays empty; other columns are kept.
    """
    sets = boilerplate(docs, host_col, text_col, ratio, min_pages)
    joined = docs.withColumn(HOST, F.coalesce(F.col(host_col), F.lit(""))).join(sets, HOST, "left")
    lines = _lines(whole_text(text_col))
    often = F.coalesce(F.col(SETS), F.array().cast(docs.sparkSession.range(0).select(F.array(_key(F.lit("")))).schema[0].dataType))
    out = joined.withColumn(KEYS, F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(often, _key(x)))))
    whole, left = F.size(F.filter(lines, _has_word)), F.size(F.filter(F.col(KEYS), _has_word))
    dropped = F.when(left > 0, whole - left).otherwise(0)
    out = out.withColumn(KEYS, F.when(F.col(SETS).isNull(), F.struct(F.col(text_col).alias("text"), whole.alias("n"), F.lit(0).alias("d"))).otherwise(
        F.struct(F.when(dropped > 0, F.array_join(KEYS, "\n")).otherwise(F.col(text_col)).alias("text"), whole.alias("n"), dropped.alias("d"))))
    columns = [F.col(f"{KEYS}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    extra = [F.col(f"{KEYS}.n").cast("long").alias("n_lines"), F.col(f"{KEYS}.d").cast("long").alias("n_dropped")] if counts else []
    return out.select(*columns, *extra)
