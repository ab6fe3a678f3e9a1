import pytest

from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls, empty and white texts, ties, repeated rows, clashing columns."""
    base = " ".join(f"word{i % 37}x{i}" for i in range(120))
    rows = [
        (1, base, "a", "x"),
        (2, base, "a", None),
        (2, base, "a", None),
        (3, None, "a", "x"),
        (4, "", None, "x"),
        (5, " \t\n \x0b", None, "x"),
        (None, "two words", "b", "x"),
        (6, "éclair ÉCLAIR <|endoftext|>  odd space it's 12345", "b", "y"),
        (7, "same line\n" + base + "\nsame line", "b", "y"),
        (8, "again " * 400, "c", "y"),
        (9, "x" * 30000, "c", "y"),
    ]
    schema = "doc_id long, text string, source string, n_chars string"
    return spark.createDataFrame(rows, schema).withColumn("words", F.lit(1)).withColumn("id", F.lit("z")).withColumn("row", F.lit(2)).withColumn("bucket", F.lit(0))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}
