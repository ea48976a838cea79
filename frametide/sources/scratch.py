"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Where each table of :func:`written` lies.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only in local mode, where driver and executors are one process, may it be
    unset; elsewhere a machine's own folder would lose rows, so that fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends if it is still there."""
    path = f"{shared_dir(spark)}/frametide-{label}-{uuid.uuid4().hex}"
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str, *, few: bool = False) -> DataFrame:
    """``df`` as a written table: computed once however often it is read, and not again when executors are lost.

    ``few``: at most two files a core, for tables of a few numbers a row, which
    as many files as there are shuffle partitions would make all overhead. The
    table goes with :func:`discard`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if few:
        df = df.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at, files = _hadoop(spark, path)
    files.delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of :func:`written` that nothing reads any more; other DataFrames and None are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None) if df is not None else None
        if path:
            remove(df.sparkSession, path)
