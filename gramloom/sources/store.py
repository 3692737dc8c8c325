"""Tables written on the way, in the folder that the cluster shares. They go when the application ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
_marked: set[str] = set()


def _path(spark: SparkSession, path: str):
    """The path and its file system, as the cluster's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set (tests)."""
    global _local
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    _local = _local or "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _local


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path for a table of this application, below a folder that is deleted when the application's JVM ends."""
    base = f"{folder(spark)}/gramloom/{spark.sparkContext.applicationId}"
    if base not in _marked:
        at, files = _path(spark, base)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _marked.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table", by: tuple[str, ...] = ()) -> DataFrame:
    """df, written as Parquet and read again: its lineage ends here, and losing an executor costs no recomputation. With
    `by` there is a folder for each value, and readers skip the others."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at path: a stage can be skipped when it does."""
    at, files = _path(spark, f"{path.rstrip('/')}/_SUCCESS")
    return files.exists(at)


def stage(spark: SparkSession, path: str, build, *partition_by: str) -> DataFrame:
    """The table at path, built and written only if no finished one is there."""
    if not exists(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
