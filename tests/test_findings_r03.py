"""The driver's findings of round 3 on small rows that show them."""

from __future__ import annotations

import math
import random
import re
import struct
import time
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import similarity
from quillspan.operators import chunking, combined, entities, evaluate, matching, pipelines, providers, retrieval
from quillspan.operators.calls import CallTable
from quillspan.operators.text_index import TextIndex


def test_semantic_cuts_below_a_likeness_and_not_at_it(spark):
    """Neighbours whose cosine is exactly ``similar`` stay together: (1, 0) and (7, sqrt(51)) in whole numbers."""
    pairs = [(a, b) for a in range(1, 200) for b in range(a, 200) if math.isqrt(a * b) ** 2 == a * b and math.isqrt(a * b) % 10 == 0]
    a, b = next((a, b) for a, b in pairs if 0.7 * math.isqrt(a * b) / (math.sqrt(a) * math.sqrt(b)) < 0.7 and _squares(a, b))
    x, y = _squares(a, b)
    rows = [(1, 0, "v" * 300, 0, 300, x), (1, 1, "w" * 20, 300, 320, y)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, text string, start int, end int, vector array<double>")
    assert chunking.semantic(df, "doc_id").count() == 1


def _squares(a: int, b: int):
    """Whole-numbered vectors of squared lengths a and b at a cosine of 0.7, if there are small ones."""
    of = lambda n: [(i, j, k) for i in range(15) for j in range(15) for k in range(15) if i * i + j * j + k * k == n]
    dot = 7 * math.isqrt(a * b) // 10
    return next((([*map(float, x)], [*map(float, y)]) for x in of(a) for y in of(b) if sum(map(int.__mul__, x, y)) == dot), None)


def test_models_are_ranked_by_scores_rounded_in_binary(spark, tmp_path):
    """6395.5 / 10000 lies below the half."""
    spark.createDataFrame([(1, "a", 1, 6395.0), (2, "b", 1, 6395.5)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = entry.queries()["rank_models"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.model, r.f1) for r in got] == [("a", 0.6395), ("b", 0.6395)]


def test_pooled_means_are_rounded_in_binary(spark, tmp_path):
    """A mean whose shortest decimals end in a five, and that lies below the half all the same."""
    near = lambda t: math.floor(t * 1e6 + 0.5) / 1e6
    half = lambda t: float(Decimal(repr(t)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    mean = next(t for t in ((10 * k + 5) / 1e7 for k in range(10_000, 90_000)) if near(t) != half(t) and (t * 3) / 3 == t)
    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    a = single(mean * 3)
    b = single(mean * 3 - a)
    c = mean * 3 - a - b
    assert single(c) == c and (a + b + c) / 3 == mean
    spark.createDataFrame([(3, [*[a] * 16, *[b] * 16, *[0.0] * 16, *[c] * 16])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert entry.queries()["pool_tokens"](spark, str(tmp_path)).first()["mean"] == [near(mean)] * 16


def test_section_chunks_fold_batches_of_documents(spark):
    """No group of its own for a document: a document's sections are a row, and the plan has one pass in Python."""
    df = spark.createDataFrame([(1, "ARTICLE I " + "x" * 200 + "\nARTICLE II a\nARTICLE III b"), (2, "ARTICLE I a\nARTICLE II " + "y" * 130)], "k int, text string")
    got = chunking.section_chunks(chunking.sections(df, "k"), "k")
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "ArrowEvalPython" in plan
    assert [(r.k, r.chunk_id, len(r.text), r.start, r.end, r.kind) for r in got.orderBy("k", "chunk_id").collect()] == [(1, 0, 210, 0, 211, "article"), (1, 1, 27, 211, 237, "merged"), (2, 0, 11, 0, 12, "merged"), (2, 1, 141, 12, 153, "article")]


def test_model_weights_move_no_rows(spark):
    """Weights are sent to the entities; a join by model would deal all rows to as many tasks as there are models."""
    rows = spark.createDataFrame([(1, "m0", 0, "A", "x", 0.5), (1, "m1", 1, "A", "X", 0.5)], "doc_id int, model string, seq int, type string, value string, confidence double")
    weights = spark.createDataFrame([("m0", 0.4)], "model string, weight double")
    got = entities.ensemble(rows, weights, "doc_id", "union")
    assert "hashpartitioning(model" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.value, r.confidence) for r in got.collect()] == [("X", 0.5)]


def test_index_ties_go_by_id_whatever_order_words_are_summed_in(spark):
    """Chunks whose words have the same weights, dealt otherwise, tie in nine places; their sums differ in the last."""
    r, words, often = random.Random(1), [f"word{k}" for k in range(29)], list(range(1, 30))
    rows = [(1, i, "filler") for i in range(100, 160)]
    for i in range(20):
        r.shuffle(often)
        rows.append((1, i, " ".join(f"{w} " * n for w, n in zip(words, often, strict=True))))
    index = TextIndex.build(spark.createDataFrame(rows, "g long, chunk_id long, text string"), "g", block=4)
    asked = spark.createDataFrame([(1, "q", " ".join(words))], "g long, query_id string, query string")
    got = sorted((x["rank"], x.chunk_id) for x in index.search(asked, 5).collect())
    assert got == [(i + 1, i) for i in range(5)]


def test_grams_of_a_long_text_take_time_by_its_length(spark):
    """Words are found once, not again for each pair."""
    df = spark.createDataFrame([("w%d " * 20_000 % tuple(range(20_000)),)], "t string")
    began = time.time()
    assert df.select(F.size(retrieval._grams(F.col("t")))).first()[0] == 39_999
    assert time.time() - began < 60
    assert spark.createDataFrame([("Ab c de",), ("one",), ("",)], "t string").select(retrieval._grams(F.col("t")).alias("g")).collect() == [(["ab", "de", "ab de"],), (["one"],), ([],)]


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """Call tables, taggers and the compatibility form see 4 MB at once; another value of the session is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    try:
        for use in (lambda: CallTable(spark, str(tmp_path)), lambda: pipelines.tag_long(docs, pipelines.rule_spans({"A": "a"})), lambda: pipelines.segmented(docs, {"A": ["a"]}, pipelines.rule_spans({"A": "a"}))):
            spark.conf.unset(key)
            use()
            assert int(spark.conf.get(key)) == 4 << 20
        spark.conf.set(key, "1000000")
        CallTable(spark, str(tmp_path))
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@pytest.mark.parametrize("best", [True, False])
def test_pooled_matching_in_turns_holds_few_pairs(spark, monkeypatch, best):
    """Turns of a few predictions and lists cut after a few golds give what one loop gives; no step writes all pairs."""
    r = random.Random(11)
    words = ["acme", "corp", "limited", "of", "north", "the", "and", "co"]
    make = lambda n: [(i // 9, r.choice("AB"), i % 9, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for i in range(n)]
    pred, gold = make(60), make(60)
    want = {}
    for t in "AB":
        used, golds = set(), [(set(v.split()), i) for i, (_, k, _, v) in enumerate(gold) if k == t]
        for p in (set(v.split()) for _, k, _, v in pred if k == t):
            options = [(-len(p & g) / len(g) if best else 0, i) for g, i in golds if i not in used and 2 * len(p & g) >= len(g)]
            used |= {min(options)[1]} if options else set()
        want[t] = len(used)
    save, sizes = matching.save, []
    monkeypatch.setattr(matching, "save", lambda df, path: (got := save(df, path), sizes.append(got.count()) if "listed" in path else None)[0])
    monkeypatch.setattr(matching, "TURN", 25)
    monkeypatch.setattr(matching, "LISTED", 60)
    monkeypatch.setattr(matching, "SPARE", 2)
    schema = "doc_id long, type string, seq long, value string"
    got = evaluate.greedy_protocol(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema), ["type"], best=best, pooled=True)
    assert {x.type: x.tp for x in got.collect()} == want
    assert len(sizes) > 3 and max(sizes) <= 25 * 4 * 3


def test_prompts_are_neither_sorted_nor_moved_twice(spark, tmp_path, monkeypatch):
    """A step deals its prompts once, without a sort, and still makes one call for equal ones, also beyond what a task remembers."""
    from quillspan.operators import calls as C

    frame, plans = type(spark.range(0)), []
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1]))
    monkeypatch.setattr(C, "REMEMBERED", 1)
    calls = CallTable(spark, str(tmp_path / "calls"))
    rows = spark.range(60).select("id", F.concat(F.lit("Document:\nx@y.zz "), (F.col("id") % 7).cast("string")).alias("p"))
    for most in (5, 7):
        got = calls.ask(rows.where(F.col("id") % 7 < most), F.col("p"), providers.create("rules"))
        assert got.where("g.reply like '%x@y.zz%'").count() == rows.where(F.col("id") % 7 < most).count()
        assert calls.log().count() == most
    assert len(plans) == 2 and all("Sort" not in p for p in plans) and plans[0].count("Exchange") == 1


def test_rules_are_tried_where_they_can_match():
    r = random.Random(5)
    parts = ["a@b.co", "@", "1.2.3.4", "1.2", "\u0661\u0662.3.4.5", "1234567890123456", "12345678901234567", "+1 (234) 567-8901", "0123456789abcdef" * 2 + "01234567", "f" * 40, "f" * 41, "x", "_"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice(["", " ", "."]) for _ in range(r.randrange(6)))
        assert providers.matches(providers.RULES, text) == [(t, m) for t, p in providers.RULES.items() for m in dict.fromkeys(re.findall(p, text))]


def test_small_negative_numbers_round_to_a_negative_zero(spark, tmp_path):
    """As in DuckDB, where round(-1e-9, 6) is -0.0."""
    import duckdb

    spark.createDataFrame([(3, [-1e-9, 1e-9, -0.25, 0.0] * 16)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["pool_tokens"](spark, str(tmp_path)).select("vec_id", "mean", "cls").collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert repr([tuple(r) for r in got]) == repr(duckdb.sql(entry.oracle_sql()["pool_tokens"]).fetchall())
    assert repr(got[0].cls[0]) == "-0.0"


def test_greedy_protocol_computes_its_values_once(spark):
    """The plan reads saved values; what they come from isn't in it any more."""
    rows = spark.createDataFrame([(1, "A", 0, "a b"), (1, "A", 1, "c")], "doc_id long, type string, seq long, value string").withColumn("value", F.concat("value", F.lit(" marked")))
    got = evaluate.greedy_protocol(rows, rows, ["type"])
    assert " marked" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.tp, r.fp, r.fn) for r in got.collect()] == [(2, 0, 0)]


def test_combined_match_deals_a_group_in_cells(spark, monkeypatch):
    """A document's many values are compared in cells dealt over tasks, each with few values, and give what one loop over all pairs gives; repeated and equal values too."""
    r = random.Random(21)
    words = ["acme", "corp", "limited", "of", "north", "the", "and", "co"]
    value = lambda: " ".join(r.choice(words) for _ in range(r.randrange(0, 6))) + r.choice(["", ".", " , ,"])
    pred, gold = ([(1, "A", k, value()) for k in range(70)] for _ in range(2))
    pred += [(1, "A", 70, "Acme  North!"), (1, "A", 71, None), (None, "A", 72, "acme"), (2, "A", 73, "acme"), (1, "A", 0, pred[0][3]), (1, "A", None, "acme")]
    gold += [(1, "A", 80, "north acme"), (1, "A", 82, "ACME north."), (1, "A", 81, "acme north;"), (1, "A", 83, None), (None, "A", 84, "acme")]
    norm = lambda v: " ".join(v.lower().split()).translate({ord(c): None for c in ".,;:!?"})
    want = []
    for d, t, s, v in pred:
        scored = [(0, 0, "")]
        for e, _, z, g in gold:
            if e == d == 1 and s is not None and v is not None and g is not None:
                a, b = set(norm(v).split()), set(norm(g).split())
                ratio = SequenceMatcher(None, norm(v), norm(g)).ratio()
                scored.append((-(0.4 * (len(a & b) / len(b) if b else 0) + 0.3 * ratio + 0.3 * ratio), z, g))
        best = min(scored)
        want.append((d, t, s, v, best[2] if -best[0] >= 0.5 else None))
    frame, cells = type(spark.range(0)), []
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **b: (cells.append(df), run(df, *a, **b))[1])
    monkeypatch.setattr(combined, "BLOCK", 8)
    schema = "doc_id long, type string, seq long, value string"
    got = evaluate.best_match(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)).select("doc_id", "type", "seq", "value", "gold")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    sizes = cells[0].select(F.size("asks"), F.size("golds"), F.spark_partition_id()).collect()
    assert len(sizes) > 20 and max(max(x[0], x[1]) for x in sizes) <= 24 and len({x[2] for x in sizes}) == 4


def test_common_subsequences_of_many_pairs(monkeypatch):
    r = random.Random(8)
    for step, table in ((1 << 14, 1 << 21), (3, 5), (50, 300)):
        monkeypatch.setattr(combined, "STEP", step)
        monkeypatch.setattr(combined, "TABLE", table)
        for letters in ("ab ", "abcdefgh  ", "aé漢\U0001f600 b"):
            x, y = (["".join(r.choice(letters) for _ in range(n)) for n in (0, 1, 5, 30, 63, 64, 65, 130, 300)] for _ in range(2))
            x[3] = y[4][10:40]
            p, g = (np.array([r.randrange(9) for _ in range(60)]) for _ in range(2))
            for i, j, n in zip(p, g, combined.common_subsequence(x, y, p, g), strict=True):
                assert (2 * int(n) / (len(x[i]) + len(y[j])) if x[i] or y[j] else 1.0) == similarity.indel(x[i], y[j])
            assert all(combined.sequence(a, b) == SequenceMatcher(None, a, b).ratio() for a in x for b in y)


def test_combined_protocol_splits_its_texts_once(spark):
    """The plan reads what was saved; conversations and their splitting aren't in it any more."""
    got = entry.queries()["combined_protocol"](spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and all("/matching-" in f for f in got.inputFiles())
