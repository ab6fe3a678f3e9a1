"""Versioned tables in partitions: an update writes the partitions it touches, older versions stay readable.

``base/data/v=<n>/<part>=<value>`` holds what version n wrote, and
``base/versions/v=<n>`` is its published list (value, version) of all partitions;
a version counts once the list's ``_SUCCESS`` is there. An interrupted update
leaves no trace in any list, and a repeated one overwrites its own folder.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the completely written folders ``base/v=<n>``, ascending."""
    fs, path = file_system(spark, base)
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        match = re.fullmatch(r"v=(\d+)", name)
        if match and fs.exists(file_system(spark, f"{base}/{name}/_SUCCESS")[1]):
            out.append(int(match.group(1)))
    return sorted(out)


def published(spark: SparkSession, base: str, upto: int | None = None) -> list[int]:
    """Published versions, ascending, those up to ``upto`` only if given."""
    return [v for v in versions(spark, f"{base}/versions") if upto is None or v <= upto]


def partitions(spark: SparkSession, base: str, version: int) -> dict[int, int]:
    """The version that holds each partition: as many entries as there are partitions."""
    rows = spark.read.schema("part int, v int").parquet(f"{base}/versions/v={version}").collect()
    return {r["part"]: r["v"] for r in rows}


def read(spark: SparkSession, base: str, version: int | None = None, only: Collection[int] | None = None) -> DataFrame | None:
    """A version (the newest by default), or some partitions of it; None where there is nothing."""
    done = published(spark, base, version)
    if not done:
        return None
    held = partitions(spark, base, done[-1])
    paths = [f"{base}/data/v={v}/part={p}" for p, v in sorted(held.items()) if only is None or p in only]
    return spark.read.option("basePath", f"{base}/data").parquet(*paths).drop("v", "part") if paths else None


def publish(rows: DataFrame, base: str, version: int | None = None, whole: bool = False) -> int | None:
    """Writes ``rows``, which hold the whole new content of every partition (int column ``part``) they touch.

    The other partitions stay as the newest version before has them; with
    ``whole`` there are no others, and without rows nothing is published (None).
    ``version`` is the next number by default; a caller that may repeat an update
    names it. Rows of a partition meet before they are written, those of a large
    one in several tasks, so the files follow the rows, not tasks times partitions.
    """
    spark = rows.sparkSession
    done = published(spark, base, None if version is None else version - 1)
    version = (done[-1] + 1 if done else 1) if version is None else version
    held = partitions(spark, base, done[-1]) if done and not whole else {}
    path = f"{base}/data/v={version}"
    rows.hint("rebalance", "part").write.partitionBy("part").mode("overwrite").parquet(path)
    fs, target = file_system(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    if whole and not any(n.startswith("part=") for n in names):
        return None
    held |= {int(n.removeprefix("part=")): version for n in names if n.startswith("part=")}
    spark.createDataFrame(sorted(held.items()), "part int, v int").coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/v={version}")
    return version
