"""Blocked dense search against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from quillspan.operators import dense, retrieval


def score(q, c, measure):
    if measure == "cosine":
        return float(q @ c) / max(np.linalg.norm(q) * np.linalg.norm(c), 1e-10)
    return float(q @ c) if measure == "dot" else 1 / (1 + float(np.linalg.norm(q - c)))


@pytest.mark.parametrize("blocks", [(8192, 1024), (7, 3)])
@pytest.mark.parametrize("measure", dense.MEASURES)
def test_blocks_against_all_pairs(spark, monkeypatch, blocks, measure):
    monkeypatch.setattr(dense, "CHUNKS", blocks[0])
    monkeypatch.setattr(dense, "QUERIES", blocks[1])
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    base[5:12] = base[4]  # ties go to the smaller id
    base[20] = 0
    chunks = [(g, i, [float(x) for x in base[i]]) for g in ("a", "b") for i in range(40) if (g, i) != ("b", 4)]
    chunks += [("a", 100, None), ("a", 101, [1.0, None] + [0.0] * 6), ("a", 102, [1.0, 2.0]), ("c", 1, [1.0] * 8), ("a", 103, [])]
    queries = [(g, f"q{i}", [float(x) for x in base[i]]) for g in ("a", "b") for i in range(0, 40, 4)] + [("a", "none", None), ("a", "two", [2.0, 1.0]), ("d", "alone", [1.0] * 8)]
    got = {}
    made = retrieval.dense(spark.createDataFrame(chunks, "g string, chunk_id long, vector array<double>"), spark.createDataFrame(queries, "g string, query_id string, query_vector array<double>"), "g", 5, measure, None)
    for r in made.collect():
        got.setdefault((r.g, r.query_id), {})[r["rank"]] = (r.chunk_id, round(r.score, 9))
    want = {}
    for g, q, v in queries:
        scored = [(-score(np.array(v), np.array(c), measure), i) for h, i, c in chunks if h == g and v and c and None not in c and len(c) == len(v)]
        exact = sorted((round(s, 12), i) for s, i in scored)[:5]
        if exact:
            want[g, q] = {k + 1: (i, round(-s, 9)) for k, (s, i) in enumerate(exact)}
    assert {k: {r: c for r, (c, _) in v.items()} for k, v in got.items()} == {k: {r: c for r, (c, _) in v.items()} for k, v in want.items()}
    assert all(abs(got[k][r][1] - want[k][r][1]) < 1e-8 for k in want for r in want[k])
    assert dense.search(spark.createDataFrame([], "g string, chunk_id long, vector array<double>"), spark.createDataFrame(queries, "g string, query_id string, query_vector array<double>"), "g", 5, measure).count() == 0
    with pytest.raises(ValueError):
        dense.search(made, made, "g", 5, "other")


def test_a_block_gives_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(dense, "CHUNKS", 50)
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(0, i, [float(x) for x in rng.normal(size=4)]) for i in range(400)], "g int, chunk_id int, vector array<float>")
    queries = chunks.where("chunk_id < 20").selectExpr("g", "chunk_id as query_id", "vector as query_vector")
    found = dense.search(chunks, queries, "g", 3, "dot")
    assert found.count() <= 20 * 3 * 8 and found.schema["chunk_id"].dataType.simpleString() == "int"
