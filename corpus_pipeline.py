"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and works on all rows its predecessor kept.  ``run`` applies them to
``documents``, writing each stage's rows as Parquet in the shared folder and
reading them again as the next one's input.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import bpe, decontam, quality, similar, substring
from quillspan.llm.queries import tokenizer_path
from quillspan.llm.scratch import Scratch, few_files, files_for

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document stays if the classifier gives label 1 this likelihood or more.
LEAST_QUALITY = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; it learns from the labelled rows that are not held out.

    Null texts are scored as empty ones, repeated rows alike; without any
    labelled row all documents score 0.5 and stay; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by similarities of 0.8 or more on five-word shingles keep one, the one with the smallest id.

    Rows are documents, also where several have one id: each is compared by
    its own text, and of a group's rows with its smallest id one stays.  Rows
    with a null id stay.
    """
    known = docs.where("doc_id is not null")
    again = known.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        got = similar.similar_documents(docs, shingle=5, similarity=0.8)
        gone = got.where("id <> component").select(F.col("id").alias("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # rows that share an id get numbers of their own, which hold once they are written; no id is expected beyond 2^62
    node = F.when(F.col("again"), F.lit(1 << 62) + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    rows = Scratch(spark, "near", docs).save(known.join(again, "doc_id", "left").withColumn("_node", node).drop("again"))
    got = similar.similar_documents(rows, id_col="_node", shingle=5, similarity=0.8)
    own = rows.select(F.col("_node").alias("id"), "doc_id").join(got, "id")
    stays = own.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("x")).select(F.col("x.id").alias("_node"))
    kept = rows.join(stays, "_node", "left_semi").select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 35 words or more that occurs elsewhere; documents without one keep their text as it is, null texts too."""
    got = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    cut = got.select("row", text.alias("text"))
    chars = F.when(F.col("text").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))
    return cut.select(*[{"text": F.col("text"), "n_chars": chars.alias("n_chars")}.get(c, F.col(f"row.{c}").alias(c)) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain 0.8 or more of a test item's five-word shingles.

    Null texts contain nothing and stay; repeated rows go or stay alike.
    """
    hits = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.where("n_items = 0").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them; a null text has none."""
    got = bpe.encode_decode(docs, tokenizer_path(), with_ids=True)
    return got.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")




def _in_few_files(stage):
    """The stage's rows in no more files than a table of its input's size should have."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return few_files(stage(spark, docs, sf_dir), files_for(docs))

    return run


STAGES = [
    ("quality classifier", _in_few_files(quality_filter)),
    ("near-duplicates", _in_few_files(near_duplicates)),
    ("repeated passages", _in_few_files(repeated_passages)),
    ("benchmark leaks", _in_few_files(benchmark_leaks)),
    ("tokens", _in_few_files(tokens)),
]

#: No SQL: the first stage is a trained model.  Tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs
