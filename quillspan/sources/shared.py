"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local runs without one get a temporary folder, others raise."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def open_store(path: str):
    """(file system, path in it) of a URI, for tasks; local paths and file: URIs included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its Path class) of a URI, for the driver."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def save(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written files."""
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most, if the session has Spark's default of 64 MB: texts and what Python makes of them grow many times in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, str(4 << 20))
