"""A stored inverted index for BM25: built once, read by many sets of queries, with an early stop for the best k.

Postings lie in buckets of (group, word), so a set of queries opens the
buckets of its own words only.  A word's postings are blocks by falling
impact, each with its greatest one; a second table has each chunk's words with
their impacts.  A search reads the first blocks of its words, scores every
chunk it meets there exactly by the second table, and compares the k-th best
score with what a chunk in none of these blocks could reach at most, the sum of
the next blocks' greatest impacts.  Queries whose k-th best is more are done;
for the others four times as many blocks are read.  So long lists of common
words are read as far as they can matter, and the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.numbers import rounded
from quillspan.functions.text import tokens
from quillspan.operators.retrieval import top_k
from quillspan.sources.shared import fresh_folder, save

#: Postings in a block, and folders that the words are dealt into.
BLOCK, BUCKETS = 256, 64


def _bucket(on: str, n: int) -> Column:
    return F.pmod(F.xxhash64(on, "w"), F.lit(n)).cast("int")


@dataclass
class TextIndex:
    """``path``/postings (bucket, on, w, idf, no, top, list) and ``path``/chunks (on, chunk_id, words: map of word to impact)."""

    spark: SparkSession
    path: str
    on: str
    buckets: int

    @classmethod
    def build(cls, chunks: DataFrame, on: str, path: str | None = None, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, block: int = BLOCK, buckets: int = BUCKETS) -> TextIndex:
        """Index chunks (on, chunk_id, text) of groups ``on``; negative idf become ``floor`` times the group's mean.

        Null texts have no words but count as chunks; groups and chunk ids aren't null.
        """
        spark, path = chunks.sparkSession, path or fresh_folder(chunks.sparkSession, "index")
        words = save(chunks.select(on, "chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words")), f"{path}/words")
        group = words.groupBy(on).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"))
        tf = words.select(on, "chunk_id", F.size("words").alias("dl"), F.explode("words").alias("w")).groupBy(on, "chunk_id", "dl", "w").agg(F.count("*").alias("tf"))
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        one = save(tf.join(group, on).select(on, "chunk_id", "w", "n", impact.alias("i")), f"{path}/impacts")
        raw = one.groupBy(on, "w").agg(F.first("n").alias("n"), F.count("*").alias("df")).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        raw = save(raw, f"{path}/terms")
        mean = raw.groupBy(on).agg(F.avg("raw").alias("mean"))
        idf = raw.join(mean, on).select(on, "w", F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        # a word's list is sorted by range of (group, word, impact), and its blocks are runs of that order: no list is one row
        ordered = one.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), on, "w", F.desc("i"), "chunk_id").sortWithinPartitions(on, "w", F.desc("i"), "chunk_id")
        ordered = save(ordered.select(on, "w", "chunk_id", "i", F.monotonically_increasing_id().alias("place")), f"{path}/ordered")
        # blocks end where a range does, so they may be smaller, never larger
        first = ordered.groupBy(on, "w", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"))
        cut = ordered.withColumn("part", F.shiftright("place", 33)).join(first, [on, "w", "part"])
        blocks = cut.groupBy(on, "w", "part", F.floor((F.col("place") - F.col("first")) / block).alias("k")).agg(F.max("i").alias("top"), F.collect_list("chunk_id").alias("ids"))
        from pyspark.sql import Window

        no = F.row_number().over(Window.partitionBy(on, "w").orderBy("part", "k")) - 1
        blocks = blocks.withColumn("no", no).join(idf, [on, "w"]).select(_bucket(on, buckets).alias("bucket"), on, "w", "idf", "no", "top", "ids")
        blocks.repartition("bucket").sortWithinPartitions("bucket", on, "w", "no").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
        forward = one.groupBy(on, "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "i"))).alias("words"))
        save(forward, f"{path}/chunks")
        return cls(spark, path, on, buckets)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(on, query_id, chunk_id, score, rank): the ``k`` best chunks of each query (on, query_id, query) of its group, scores above 0.

        Scores that agree in nine places are ties, whatever order their words were summed in; ties go by the smaller id.
        """
        on, keys, out = self.on, [self.on, "query_id"], fresh_folder(self.spark, "search")
        asked = queries.select(on, "query_id", F.explode(tokens(F.col("query"))).alias("w")).groupBy(on, "query_id", "w").agg(F.count("*").alias("qf"))
        asked = save(asked.withColumn("bucket", _bucket(on, self.buckets)), f"{out}/asked")
        own = [r.bucket for r in asked.select("bucket").distinct().collect()]  # numbers below ``buckets``
        if not own:
            return self.spark.createDataFrame([], top_k(queries.select(on, "query_id", F.lit(0).alias("chunk_id"), F.lit(0.0).alias("score")), keys, k).schema)
        lists = self.postings().where(F.col("bucket").isin(own)).join(asked, [on, "w", "bucket"]).select(*keys, "w", "qf", "idf", "no", "top", "ids")
        lists = save(lists, f"{out}/lists")
        terms = lists.groupBy(*keys).agg(F.collect_set(F.struct("w", (F.col("qf") * F.col("idf")).alias("y"))).alias("terms"))
        forward = self.spark.read.parquet(f"{self.path}/chunks")
        left, depth, found = lists, 1, []
        while True:
            met = left.where(F.col("no") < depth).select(*keys, F.explode("ids").alias("chunk_id")).distinct()
            score = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["y"] * F.coalesce(F.try_element_at(F.col("words"), t["w"]), F.lit(0.0)))
            scored = met.join(terms, keys).join(forward, [on, "chunk_id"]).select(*keys, "chunk_id", score.alias("score")).where("score > 0")
            best = save(top_k(scored.withColumn("near", rounded("score", 9)), keys, k, "near").drop("near"), f"{out}/best-{depth}")
            # less a place, so that a chunk that could tie is met too
            last = best.groupBy(*keys).agg(F.min(F.when(F.col("rank") == k, F.col("score") - 1.5e-9)).alias("kth"))
            # what a chunk in none of the blocks read can reach: words of negative weight can only lower it
            rest = left.where(F.col("no") == depth).groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.col("qf") * F.col("idf") * F.col("top"))).alias("rest"))
            more = save(rest.join(last, keys, "left").where("kth is null or rest >= kth").select(*keys), f"{out}/more-{depth}")
            if more.isEmpty():
                return self._joined([*found, best])
            found.append(best.join(more, keys, "left_anti"))
            left, depth = left.join(more, keys), 4 * depth

    def _joined(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
