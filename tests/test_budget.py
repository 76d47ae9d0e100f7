"""The streaming budget against a batch window: order, restarts, late and null rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quillspan.streaming import budget

SCHEMA = "provider string, call_id long, ts timestamp, cost double"


def calls(n: int = 300):
    r = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    out = [(r.choice("ab"), i, start + dt.timedelta(minutes=r.randrange(3000)), r.choice([None, 0.0, 1.5, 2.25])) for i in range(n)]
    return out + [("c", 1000, start, 500.0), (None, 1001, start, 1.0)]


def shape(df):
    return sorted(map(str, df.select("provider", "call_id", "ts", "cost", F.round("total", 6).alias("t"), "within_budget", "passes").collect()))


def test_replay_is_the_window(spark, tmp_path):
    df = spark.createDataFrame(calls(), SCHEMA)
    want = budget.batch_budget(df, 40.0)
    for steps in (1, 4):
        got = budget.replay(df, 40.0, steps=steps, path=(tmp_path / str(steps)).as_uri())
        assert shape(got) == shape(want)
    assert sorted(r.provider for r in want.where("passes").collect()) == ["a", "b", "c"]
    assert {r.provider for r in want.where("not within_budget").collect()} == {"a", "b", "c"}


def test_a_stream_goes_on_and_drops_late_rows(spark, tmp_path):
    """Rows behind the watermark are dropped; totals outlive a restart."""
    path, start = tmp_path.as_uri(), dt.datetime(2024, 1, 1)
    kind = spark.createDataFrame([], SCHEMA).schema
    steps = [
        [("a", 1, start, 1.0), ("a", 3, start + dt.timedelta(hours=30), 4.0)],
        [("a", 2, start + dt.timedelta(hours=1), 100.0), ("a", 4, start + dt.timedelta(hours=29, minutes=30), 2.0)],
        [("a", budget.CLOSING, start + dt.timedelta(days=9), 0.0)],
    ]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{k}")
        budget.run_stream(spark, kind, path, 5.0, "provider")
    got = spark.read.parquet(f"{path}/out").where(F.col("call_id") != budget.CLOSING).orderBy("ts").collect()
    # the second step's first row is a day late; its other one is in time and comes before the call of hour 30
    assert [(r.call_id, r.total, r.within_budget, r.passes) for r in got] == [(1, 1.0, True, False), (4, 3.0, True, False), (3, 7.0, False, True)]
