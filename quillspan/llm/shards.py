"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards.  Shards of similar
size (one tier spans a factor of ``FACTOR``) are merged, ``runs`` or more at a
time, into files of about ``target`` bytes.  What a reader sees is the newest
manifest: each append or merge writes its files under fresh names first and
then commits the next version, a small file that appears whole under its final
name and is never changed; a writer that comes second for a version fails and
nothing of it is visible.  That takes a file system whose rename doesn't
replace a file (HDFS); local files are linked, which doesn't either.
"""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.warc import open_store

TARGET, RUNS, FACTOR = 128 << 20, 4, 4


class ShardStore:
    """A table of immutable shards below ``path``; ``path`` is in a folder all executors share."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, runs: int = RUNS):
        self.spark, self.path, self.target, self.runs = spark, path, target, runs
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        at = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """The shards of a version: file, bytes, rows, tier.  Its size follows the number of files, not of rows."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/_manifests/v{version:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))["shards"]
        finally:
            stream.close()

    def commit(self, base: int, shards: list[dict]) -> int:
        """Make ``shards`` version base + 1, or fail if another writer has; the file appears whole, in one step that never replaces one."""
        final = self._path(f"{self.path}/_manifests/v{base + 1:09d}.json")
        tmp = self._path(f"{self.path}/_manifests/.tmp-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": base + 1, "shards": sorted(shards, key=lambda s: s["file"])}).encode()))
        out.close()
        try:
            done = self._publish(tmp, final)
        finally:
            self._fs.delete(tmp, False)
        if not done:
            raise RuntimeError(f"version {base + 1} is committed already")
        return base + 1

    def _publish(self, tmp, final) -> bool:
        if self._fs.getScheme() != "file":
            return not self._fs.exists(final) and self._fs.rename(tmp, final)
        jvm = self.spark.sparkContext._jvm
        local = lambda path: jvm.java.io.File(path.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(local(final), local(tmp))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.target, FACTOR)) + 16)

    def append(self, rows: DataFrame) -> int:
        """Each task writes what it has as a small shard; returns the version that holds them."""
        base = self.version()
        folder = f"in-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        files = [(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")) if s.getPath().getName().endswith(".parquet")]
        return self.commit(base, self.manifest(base) + [{"file": f, "bytes": n, "tier": self.tier(n)} for f, n in files])

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """The merges that are due: bins of about the target size, from shards of one tier below it.

        What a tier of fewer than ``runs`` shards has moves up and counts with
        the next one, so fewer than ``runs`` shards that are too small stay
        unmerged over all tiers, besides single ones that fill no bin with others.
        """
        small = [s for s in shards if s["bytes"] < self.target // 2]
        tiers: dict[int, list[dict]] = {}
        for s in small:
            tiers.setdefault(s["tier"], []).append(s)
        bins, rest = [], []
        for t in sorted(tiers):
            run = sorted(rest + tiers[t], key=lambda s: (s["bytes"], s["file"]))
            if len(run) < self.runs:
                rest = run
                continue
            rest, own, size = [], [], 0
            for s in run:
                if own and size + s["bytes"] > self.target:
                    bins.append(own)
                    own, size = [], 0
                own.append(s)
                size += s["bytes"]
            bins.append(own)
        return [b for b in bins if len(b) > 1]

    def compact(self) -> int:
        """Merge until no tier holds enough runs; returns the newest version.  A merge is one task that streams its shards."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            bins = self.plan(shards)
            if not bins:
                return base
            folder = f"merged-{uuid.uuid4().hex}"
            # one partition for each bin; the lists are part of a manifest, which the driver holds anyway
            merge = _merger(self.path, folder, [[s["file"] for s in b] for b in bins])
            done = self.spark.range(0, len(bins), 1, len(bins)).mapInArrow(merge, "bin int, file string, bytes long").collect()
            gone = {s["file"] for b in bins for s in b}
            self.commit(base, [s for s in shards if s["file"] not in gone] + [{"file": r["file"], "bytes": r["bytes"], "tier": self.tier(r["bytes"])} for r in done])

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        files = [f"{self.path}/{s['file']}" for s in self.manifest(version)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def vacuum(self) -> None:
        """Delete shards that the newest version doesn't name (readers of older versions must have ended)."""
        keep = {s["file"] for s in self.manifest()}
        for folder in self._fs.listStatus(self._path(self.path)):
            name = folder.getPath().getName()
            if name.startswith(("in-", "merged-")):
                for f in self._fs.listStatus(folder.getPath()):
                    if f"{name}/{f.getPath().getName()}" not in keep:
                        self._fs.delete(f.getPath(), True)


def _merger(root: str, folder: str, bins: list[list[str]]):
    def run(batches):
        import pyarrow.parquet as pq

        store, base = open_store(root)
        for batch in batches:
            for n in batch.column(0).to_pylist():
                tmp, final = f"{base}/{folder}/.tmp-{uuid.uuid4().hex}", f"{folder}/shard-{n:06d}.parquet"
                store.create_dir(f"{base}/{folder}", recursive=True)
                with store.open_output_stream(tmp, compression=None) as sink:
                    writer = None
                    for f in bins[n]:
                        with store.open_input_file(f"{base}/{f}") as source, pq.ParquetFile(source) as shard:
                            for part in shard.iter_batches(4096):
                                writer = writer or pq.ParquetWriter(sink, part.schema.remove_metadata(), compression="zstd")
                                writer.write_batch(part.replace_schema_metadata(None), row_group_size=65536)
                            if writer is None:
                                writer = pq.ParquetWriter(sink, shard.schema_arrow.remove_metadata(), compression="zstd")
                    writer.close()
                store.move(tmp, f"{base}/{final}")
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([final]), pa.array([store.get_file_info(f"{base}/{final}").size])], ["bin", "file", "bytes"])

    return run


def shard_table(rows: DataFrame, target: int = TARGET, arrivals: int = 1) -> tuple[ShardStore, DataFrame]:
    """Append ``rows`` to a new store in the shared folder, compact it and read the committed version back.

    ``arrivals``: the rows come in so many parts, by a hash of each row, the
    store is compacted after each and every tier of merges is run through.
    Every row of any value, nulls and repeated rows included, comes back once;
    an empty table gives an empty store.  The file that a row comes from is in
    a column _shard, with more underscores if the rows have one of that name.
    """
    from quillspan.llm.scratch import Scratch

    store = ShardStore(rows.sparkSession, f"{Scratch(rows.sparkSession, 'shards').path}", target)
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(arrivals))
    for n in range(arrivals):
        store.append(rows.where(part == n) if arrivals > 1 else rows)
        store.compact()
    store.vacuum()
    name = "_shard"
    while name.lower() in (c.lower() for c in rows.columns):
        name = f"_{name}"
    return store, store.read(rows.schema).withColumn(name, F.input_file_name())
