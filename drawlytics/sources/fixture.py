"""Draw histories derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

STAR_TABLES = ("lineitem", "orders", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draws_from_orders(spark: SparkSession, sf_dir: str, series: bool = True) -> DataFrame:
    """One draw per order: the first five distinct ``l_partkey % 49 + 1`` of its
    lines. ``series`` keeps the order priority as series, else one history."""
    items = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("draw_id"),
            (F.col("l_partkey") % 49 + 1).cast("int").alias("num"),
            "l_linenumber",
        )
        .groupBy("draw_id", "num")
        .agg(F.min("l_linenumber").alias("first_line"))
    )
    # The five numbers are read off the sorted lines: no hash map of all draws, and the join keeps the order.
    ordered = W.partitionBy("draw_id").orderBy("first_line", "num")
    five = (
        items.select(
            "draw_id",
            F.row_number().over(ordered).alias("pos"),
            F.col("num").alias("n1"),
            *[F.lead("num", i - 1).over(ordered).alias(f"n{i}") for i in range(2, 6)],
        )
        .where("pos = 1 AND n5 IS NOT NULL")
        .drop("pos")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("draw_id"),
        F.col("o_orderdate").cast("date").alias("draw_date"),
        (F.col("o_orderpriority") if series else F.lit("all")).alias("series"),
        (F.col("o_custkey") % 10 + 1).cast("int").alias("chance"),
    )
    return five.join(orders, "draw_id").select(
        "series", "draw_id", "draw_date", "n1", "n2", "n3", "n4", "n5", "chance"
    )
