"""A durable table of model calls: one call for each provider and distinct prompt.

A UDF that calls a model is run again wherever a plan refers to its result,
and after every lost task.  Here a step first writes what is missing: the
distinct prompts without a reply are dealt over the executors, each reply goes
to a journal in the shared folder as it arrives, and the step's replies are
then written as one Parquet folder.  Everything else reads the table.  A task
that is tried again, or a run that is started again on the same path, takes
what the journals hold and calls for the rest only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.providers import Provider
from quillspan.sources.shared import file_system, fresh_folder, open_store, small_batches

LOG = "digest string, provider string, reply string, input_tokens long, output_tokens long, seconds double, error string"
_FIELDS = ("digest", "provider", "reply", "input_tokens", "output_tokens", "seconds", "error")
_ARROW = pa.schema([("digest", pa.string()), ("provider", pa.string()), ("reply", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("seconds", pa.float64()), ("error", pa.string())])


def identity(provider: Provider) -> str:
    """What tells providers apart in the table: ``key`` if the provider has one, else its class and options; wrappers count as what they wrap."""
    if key := getattr(provider, "key", None):
        return key
    if inner := getattr(provider, "inner", None):
        return identity(inner)
    kind = type(provider)
    return f"{kind.__module__}.{kind.__qualname__} {json.dumps(vars(provider), sort_keys=True, default=repr)}"


class Journal:
    """Replies of one partition, durable as they arrive: small files that appear whole, one for each ``every`` seconds of calls."""

    def __init__(self, folder: str, part: int, every: float):
        self.store, base = open_store(folder)
        self.base, self.every, self.rows, self.since = f"{base}/p{part:06d}", every, [], time.monotonic()

    def read(self) -> dict[str, dict]:
        from pyarrow import fs

        out = {}
        for f in self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True)):
            if f.base_name.endswith(".json"):
                with self.store.open_input_stream(f.path) as s:
                    out |= {r["digest"]: r for r in map(json.loads, s.read().decode().splitlines())}
        return out

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if time.monotonic() - self.since >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.store.create_dir(self.base, recursive=True)
            name = uuid.uuid4().hex
            with self.store.open_output_stream(f"{self.base}/{name}.tmp") as s:
                s.write("".join(json.dumps(r) + "\n" for r in self.rows).encode())
            self.store.move(f"{self.base}/{name}.tmp", f"{self.base}/{name}.json")
        self.rows, self.since = [], time.monotonic()


#: Digests that a task remembers before prompts are dealt.
REMEMBERED = 100_000


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (digest, prompt) without most repetitions: a task forgets what it has seen after ``REMEMBERED`` digests, the caller sees to the rest."""
    seen: set[str] = set()
    for batch in batches:
        new = []
        for digest in batch.column(0).to_pylist():
            new.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(new, pa.bool_()))
        if len(seen) > REMEMBERED:
            seen = set()


def _caller(provider: Provider, name: str, folder: str, every: float, gap: float):
    """Batches (digest, prompt) -> rows of the log; ``gap``: seconds between two calls of a task."""

    def call(digest: str, prompt: str) -> dict:
        began, error = time.time(), None
        try:
            reply, tokens_in, tokens_out = provider.generate(prompt)
        except Exception as e:
            reply, tokens_in, tokens_out, error = "", 0, 0, f"{type(e).__name__}: {e}"
        return dict(zip(_FIELDS, (digest, name, reply, tokens_in, tokens_out, time.time() - began, error), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        journal = Journal(folder, TaskContext.get().partitionId(), every)
        known, seen, due = journal.read(), set(), 0.0
        for batch in batches:
            rows = []
            for digest, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                row = known.get(digest)
                if row is None:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + gap
                    row = call(digest, prompt)
                    journal.add(row)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)
        journal.flush()

    return run


class CallTable:
    """Replies by provider and prompt below ``path``, a fresh folder in the shared one by default.

    ``parallel``: tasks that call at once at most, the session's shuffle
    partitions by default.  ``per_second``: calls a second of each executor,
    shared evenly by the tasks it can run.  ``every``: seconds of calls that a
    killed task may have to repeat; 0 journals each reply by itself.  A failed
    call is a row with an error and an empty reply; a later step that asks for
    it again calls again.  Null prompts are empty ones.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parallel: int | None = None, per_second: float | None = None, every: float = 1.0):
        self.spark, self.path = spark, (path or fresh_folder(spark, "calls")).rstrip("/")
        small_batches(spark)
        self.parallel, self.every = parallel, every
        self.gap = self._tasks_of_an_executor() / per_second if per_second else 0.0
        self.fs, self._path = file_system(spark, self.path)

    def _tasks_of_an_executor(self) -> int:
        conf = self.spark.sparkContext.getConf()
        cores = self.spark.sparkContext.defaultParallelism if self.spark.sparkContext.master.startswith("local") and "cluster" not in self.spark.sparkContext.master else int(conf.get("spark.executor.cores", "1"))
        return max(1, cores // int(conf.get("spark.task.cpus", "1")))

    def _folders(self, kind: str) -> list[str]:
        at = self._path(f"{self.path}/{kind}")
        return sorted(f"{self.path}/{kind}/{s.getPath().getName()}" for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def log(self) -> DataFrame:
        """The table: a row for each digest, a reply rather than an error."""
        done = self._folders("replies")
        if not done:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(*done)
        if len(done) == 1:
            return rows
        return rows.groupBy("digest").agg(F.min_by(F.struct(*_FIELDS[1:]), F.col("error").isNotNull()).alias("r")).select("digest", "r.*")

    def _recover(self) -> None:
        """Turn the journals of steps that didn't end into replies."""
        for folder in self._folders("journal"):
            rows = self.spark.read.schema(LOG).json(f"{folder}/*/*.json") if self._parts(folder) else None
            if rows is not None:
                rows.dropDuplicates(["digest"]).write.mode("overwrite").parquet(f"{self.path}/replies/{folder.rsplit('/', 1)[1]}-recovered")
            self.fs.delete(self._path(folder), True)

    def _parts(self, folder: str) -> bool:
        found = self.fs.globStatus(self._path(f"{folder}/*/*.json"))
        return bool(found)

    def ask(self, rows: DataFrame, prompt: Column, provider: Provider) -> DataFrame:
        """``rows`` with ``g``, a struct (reply, input_tokens, output_tokens, error); calls what has no reply yet, now, and never again."""
        name = identity(provider)
        keyed = rows.withColumn("_prompt", F.coalesce(prompt.cast("string"), F.lit("")))
        keyed = keyed.withColumn("_digest", F.sha2(F.concat(F.lit(name + "\x1f"), F.col("_prompt")), 256))
        self._recover()
        known = self.log().where("error is null").select(F.col("digest").alias("_digest"))
        n, step = self.parallel or int(self.spark.conf.get("spark.sql.shuffle.partitions")), uuid.uuid4().hex
        # prompts move once and are never sorted; equal ones are one before they are dealt, so that a very common one is no hot key
        todo = keyed.select("_digest", "_prompt")
        todo = todo.mapInArrow(_distinct, todo.schema).repartition(n, "_digest")
        if self._folders("replies"):
            todo = todo.join(known.hint("shuffle_hash"), "_digest", "left_anti")
        journal = f"{self.path}/journal/{step}"
        made = todo.mapInArrow(_caller(provider, name, journal, self.every, self.gap), LOG)
        made.write.option("compression", "zstd").parquet(f"{self.path}/replies/{step}")
        self.fs.delete(self._path(journal), True)
        replies = self.log().select(F.col("digest").alias("_digest"), F.struct("reply", "input_tokens", "output_tokens", "error").alias("g"))
        return keyed.drop("_prompt").join(replies, "_digest", "left").drop("_digest")

    def usage(self, prices: dict[str, tuple[float, float]] | None = None) -> DataFrame:
        """(provider, calls, errors, input_tokens, output_tokens, seconds, cost): what was called, and what it cost by (input, output) prices a thousand tokens."""
        got = self.log().groupBy("provider").agg(F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds"))
        cost = F.lit(None).cast("double")
        for name, (tokens_in, tokens_out) in (prices or {}).items():
            cost = F.when(F.col("provider") == name, (F.col("input_tokens") * tokens_in + F.col("output_tokens") * tokens_out) / 1000).otherwise(cost)
        return got.withColumn("cost", cost)

    def drop(self) -> None:
        """Delete the table and its journals."""
        self.fs.delete(self._path(self.path), True)


def answer(rows: DataFrame, prompt: Column, provider: Provider, calls: CallTable | None = None) -> DataFrame:
    """``rows`` with ``g`` from ``calls``, or without a table by a UDF that runs as often as the plan refers to it (for streams)."""
    from quillspan.operators.providers import generate

    return calls.ask(rows, prompt, provider) if calls else rows.withColumn("g", generate(prompt, provider))
