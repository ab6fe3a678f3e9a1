"""Reliable intermediate tables.

Lineage is cut by writing parquet under the shared folder the cluster names in
``spark.checkpoint.dir``, so a lost executor never loses an intermediate. They
live as long as the application.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="drawlytics-")
    sc.setCheckpointDir(root)
    return sc._jsc.sc().getCheckpointDir().get()


_MADE: set[str] = set()


def session_root(spark: SparkSession) -> str:
    """This application's folder in the shared one; the file system deletes it when the driver ends."""
    path = f"{checkpoint_root(spark)}/drawlytics/{spark.sparkContext.applicationId}"
    if path not in _MADE:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)
        _MADE.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{session_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
