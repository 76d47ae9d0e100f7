"""The stateless operators on streams, and cost per time window.  An addition; the batch operators are used unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import sentences, spaced


def sentence_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Sentences of documents that arrive as Parquet files in ``folder``."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return docs.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", spaced(F.col("s.text")).alias("text"))


def cost_windows(calls: DataFrame, ts: str = "ts", by: str = "provider", cost: str = "cost", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and cost per tumbling window; rows later than the watermark are dropped on streams."""
    w = calls.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"))
    return w.select(F.col("w.start").alias("window_start"), by, "calls", "cost")
