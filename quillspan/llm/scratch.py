"""Shared-folder tables that cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local runs without it, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quillspan-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Bytes of rows in one Arrow batch.  The JVM and a Python worker each hold a batch several times over.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches at ``BATCH_BYTES`` where the session keeps Spark's default of 64 MB.

    The setting stays in the session, because a returned plan is made when it
    runs.  Batches of narrow rows still hold as many rows as the session says.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


#: Bytes of input that go to one file of a saved table, rows of a small table, and how many times too many partitions are dealt again.
FILE_BYTES, FILE_ROWS, DEAL_AGAIN = 32 << 20, 1 << 20, 16


def files_for(df: DataFrame) -> int:
    """How many files a table of about the size of ``df`` should have: of ``FILE_BYTES`` each, and as many for each core.

    By the optimizer's estimate, which is the files' size for a table that is
    read and too large rather than too small for others.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * min(-(-max(size, 1) // (FILE_BYTES * cores)), 1 << 20)


def few_files(df: DataFrame, files: int) -> DataFrame:
    """``df`` in about ``files`` partitions if it would have many more, so that a small input doesn't become very many tiny files.

    A plan without a shuffle gets fewer tasks.  What comes from a shuffle is
    dealt again only if the session asks for over ``DEAL_AGAIN`` times as many
    partitions; otherwise adaptive execution's choice stays.
    """
    if not re.search(r"(?<!Broadcast)Exchange", df._jdf.queryExecution().executedPlan().toString()):
        return df.coalesce(files)
    return df.repartition(files) if DEAL_AGAIN * files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


@contextlib.contextmanager
def more_partitions(spark: SparkSession, times: int):
    """``times`` as many shuffle partitions for what runs inside: for a step whose rows are many times its input's, so that a task's share still fits."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(int(before) * times))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """A private folder below the shared one; tables saved there are read back as new roots of a plan.

    ``like``: a table of the size of those that will be saved; it bounds the number of files.
    """

    def __init__(self, spark: SparkSession, name: str, like: DataFrame | None = None):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.files = None if like is None else files_for(like)
        self._n = 0

    def save(self, df: DataFrame, rows: int | None = None, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads the written files; ``rows``: a bound on its rows, if it is known."""
        self._n += 1
        path = f"{self.path}/t{self._n}"
        schema = df.schema
        if rows is not None:
            df = df.repartition(1 + rows // FILE_ROWS)
        elif self.files:
            df = few_files(df, self.files)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables saved here that nothing reads any more."""
        for t in tables:
            delete(self.spark, t._scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
