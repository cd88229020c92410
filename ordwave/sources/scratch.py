"""Tables and folders that a query writes on its way."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables; one of our own only where none is set and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='ordwave-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def filesystem(path: str):
    """(pyarrow's file system, path in it) of a path or URI; for Python tasks that read or write files by themselves."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def scratch_dir(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/ordwave-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def attempt():
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            pass

    atexit.register(attempt)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what led here is not run again. The table goes when the process ends."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
