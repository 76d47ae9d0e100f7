"""A budget as streaming state: the running cost of each provider, and the call that passes its budget.

Calls arrive in any order within the watermark.  They wait in state, packed by
intervals of event time, until the watermark has passed them; a timer for each
interval then takes its calls in order of time and id, adds them to the
provider's total and emits them with it.  So the rows are those of a running
sum over a batch, however the stream was cut into micro-batches and wherever
it was stopped and started again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quillspan.sources.shared import fresh_folder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def schema(by: str) -> str:
    return f"{by} string, call_id long, ts timestamp, cost double, total double, within_budget boolean, passes boolean"


class Ledger(StatefulProcessor):
    """``total`` of what is settled, and waiting calls by the interval (milliseconds) that they are in."""

    def __init__(self, by: str, budget: float, interval_ms: int):
        self.by, self.budget, self.interval = by, budget, interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "total double")
        self.waiting = handle.getMapState("waiting", "due bigint", "ts array<bigint>, id array<bigint>, cost array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(rows)
        us = calls["ts"].astype("datetime64[us]").astype("int64")
        due = (us // 1000 // self.interval + 1) * self.interval  # an interval is settled when it has ended
        for at, own in calls.assign(us=us).groupby(due):
            at = int(at)
            packed = [own["us"].tolist(), own["call_id"].tolist(), own["cost"].astype(float).tolist()]
            if self.waiting.containsKey((at,)):
                packed = [list(a) + b for a, b in zip(self.waiting.getValue((at,)), packed, strict=True)]
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), tuple(packed))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        ts, ids, cost = self.waiting.getValue((at,))
        self.waiting.removeKey((at,))
        before = self.total.get()[0] if self.total.exists() else 0.0
        own = pd.DataFrame({"us": ts, "call_id": ids, "cost": cost}).sort_values(["us", "call_id"], kind="stable", ignore_index=True)
        own["total"] = before + own["cost"].cumsum()
        self.total.update((float(own["total"].iloc[-1]),))
        own["ts"] = pd.to_datetime(own["us"], unit="us")
        own["within_budget"] = own["total"] < self.budget
        own["passes"] = ~own["within_budget"] & (own["total"] - own["cost"] < self.budget)
        own[self.by] = key[0]
        yield own[[self.by, "call_id", "ts", "cost", "total", "within_budget", "passes"]]

    def close(self) -> None:
        pass


def running_budget(calls: DataFrame, budget: float = 100.0, by: str = "provider", late: str = "1 hour", interval: int = 3600) -> DataFrame:
    """Each call of a stream (by, call_id: long, ts, cost) with its provider's ``total`` so far; append mode.

    ``within_budget``: the total is under ``budget``; ``passes``: this call is
    the one that reached it.  Calls later than ``late`` behind the watermark
    are dropped, null costs count nothing; a call is emitted when its
    ``interval`` (seconds) lies behind the watermark.  The state store must be
    RocksDB (``STORE``).
    """
    own = calls.select(F.col(by).cast("string").alias(by), F.col("call_id").cast("long").alias("call_id"), "ts", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost")).withWatermark("ts", late)
    return own.groupBy(by).transformWithStateInPandas(Ledger(by, budget, interval * 1000), schema(by), "Append", "EventTime")


def batch_budget(calls: DataFrame, budget: float = 100.0, by: str = "provider") -> DataFrame:
    """The same rows from a table: a running sum in one window for each provider."""
    w = Window.partitionBy(by).orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = calls.select(F.col(by).cast("string").alias(by), F.col("call_id").cast("long").alias("call_id"), "ts", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"))
    own = own.withColumn("total", F.sum("cost").over(w)).withColumn("within_budget", F.col("total") < budget)
    return own.withColumn("passes", ~F.col("within_budget") & (F.col("total") - F.col("cost") < budget))


#: The id of rows that close a stream: they move the watermark past all calls and aren't calls.
CLOSING = -1


def replay(calls: DataFrame, budget: float, by: str = "provider", steps: int = 2, path: str | None = None, interval: int = 3600) -> DataFrame:
    """The table ``calls`` as a stream that is stopped and started again after each of ``steps`` stretches of time; returns what was emitted.

    A closing row for each provider, two days after the last call, moves the
    watermark past all calls.  ``path`` holds the stream's input, checkpoint
    and output, a fresh folder in the shared one by default.
    """
    spark = calls.sparkSession
    path = path or fresh_folder(spark, "budget")
    own = calls.select(by, F.col("call_id").cast("long").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("cost").cast("double").alias("cost"))
    at = F.unix_micros("ts")
    cuts = own.select(at.cast("double").alias("t")).approxQuantile("t", [k / steps for k in range(1, steps)], 0.001) if steps > 1 else []
    step = sum((F.when(at >= F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(steps):
        own.where(step == k).write.parquet(f"{path}/in/{k}")
        run_stream(spark, own.schema, path, budget, by, interval)
    last = own.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    closing = own.select(by).distinct().join(F.broadcast(last)).select(by, F.lit(CLOSING).cast("long").alias("call_id"), "ts", F.lit(0.0).alias("cost"))
    closing.coalesce(1).write.parquet(f"{path}/in/closing")
    run_stream(spark, own.schema, path, budget, by, interval)
    return spark.read.schema(schema(by)).parquet(f"{path}/out").where(F.col("call_id") != CLOSING)


def run_stream(spark, kind, path: str, budget: float, by: str, interval: int = 3600) -> None:
    """Take up the stream over the folders below ``path``/in from its checkpoint and run it to the end of what is there."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        calls = spark.readStream.schema(kind).parquet(f"{path}/in/*")
        writer = running_budget(calls, budget, by, interval=interval).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
