"""The stored index against scoring every chunk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import retrieval
from quillspan.operators.text_index import TextIndex


def corpus(seed: int = 1):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(g, i, " ".join(r.choices(words, weights, k=r.randrange(1, 30)))) for g, n in ((1, 150), (2, 5), (3, 1)) for i in range(n)]
    rows += [(2, 90, None), (2, 91, ""), (1, 900, rows[3][2]), (1, 901, rows[3][2])]
    queries = [(g, f"q{k}", " ".join(r.choices(words, k=r.randrange(1, 6)))) for g in (1, 2, 3) for k in range(6)] + [(1, "common", "word0 word1 word0"), (1, "none", "absent"), (9, "alone", "word0"), (2, "empty", ""), (1, "null", None)]
    return rows, queries


@pytest.mark.parametrize("block", [256, 4, 1])
def test_index_against_all_chunks(spark, block):
    rows, queries = corpus()
    chunks = spark.createDataFrame(rows, "g long, chunk_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "g long, query_id string, query string")
    index = TextIndex.build(chunks, "g", block=block, buckets=5)
    shape = lambda df: sorted((r.g, r.query_id, r.chunk_id, round(r.score, 7), r["rank"]) for r in df.collect())
    full = retrieval.bm25(chunks.withColumn("text", F.coalesce("text", F.lit(""))), asked, "g").withColumn("score", F.round("score", 10))
    for k in (1, 3, 10, 500):
        want = shape(retrieval.top_k(full, ["g", "query_id"], k))
        got = shape(index.search(asked, k))
        assert [x[:2] + (x[3], x[4]) for x in got] == [x[:2] + (x[3], x[4]) for x in want]
        assert {x[:3] for x in got} == {x[:3] for x in want}
    again = shape(index.search(asked.where("query_id = 'q1'"), 3))  # another set of queries on the same files
    assert again == [x for x in shape(index.search(asked, 3)) if x[1] == "q1"]
    assert index.search(asked.limit(0), 3).count() == 0


def test_a_search_opens_its_own_buckets(spark):
    rows, _ = corpus(2)
    index = TextIndex.build(spark.createDataFrame(rows, "g long, chunk_id long, text string"), "g", block=8, buckets=16)
    one = index.postings().where(F.col("bucket").isin([3]))
    files = {r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("bucket=3/" in f for f in files)
    # a word's blocks fall in impact and hold each chunk once
    for r in index.postings().groupBy("g", "w").agg(F.sort_array(F.collect_list(F.struct("no", "top", "ids"))).alias("b")).collect():
        tops = [x.top for x in r.b]
        assert [x.no for x in r.b] == list(range(len(r.b))) and tops == sorted(tops, reverse=True)
        ids = [i for x in r.b for i in x.ids]
        assert len(ids) == len(set(ids)) and all(len(x.ids) <= 8 for x in r.b)


def test_common_words_are_not_read_to_the_end(spark, monkeypatch):
    """A query with a rare word is settled by the first blocks."""
    rows = [(1, i, "common " * (1 + i % 5) + ("rare words here" if i < 12 else "filler text more")) for i in range(400)]
    chunks = spark.createDataFrame(rows, "g long, chunk_id long, text string")
    asked = spark.createDataFrame([(1, "q", "rare common")], "g long, query_id string, query string")
    index = TextIndex.build(chunks, "g", block=16)
    from quillspan.operators import text_index

    seen, real = [], text_index.save
    monkeypatch.setattr(text_index, "save", lambda df, path: (seen.append(path.rsplit("/", 1)[1]), real(df, path))[1])
    got = index.search(asked, 5).collect()
    assert sorted(r.chunk_id for r in got) == sorted(r.chunk_id for r in retrieval.top_k(retrieval.bm25(chunks, asked, "g").withColumn("score", F.round("score", 9)), ["g", "query_id"], 5).collect())
    assert [s for s in seen if s.startswith("best")] == ["best-1"]
