"""Matching in rounds, filtered similarity and overlap folds against plain Python."""

from __future__ import annotations

import collections
import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspan.functions import similarity as S
from quillspan.operators import entities, evaluate, matching
from quillspan.plans.match_queries import pred_gold

WORDS = ["acme", "corp", "inc.", "limited", "of", "north", "the", "and", "Co"]


def norm(v: str) -> str:
    return " ".join(v.lower().split()).translate({ord(c): None for c in ".,;:!?\"'()[]{}"})


def recall(p: str, g: str) -> float:
    a, b = set(norm(p).split()), set(norm(g).split())
    return len(a & b) / len(b) if b else 0.0


def rows(seed: int, docs: int = 6, n: int = 40):
    r = random.Random(seed)
    return [(d, r.choice("AB"), i, " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 6)))) for d in range(docs) for i in range(n)]


SCHEMA = "doc_id long, type string, seq long, value string"


@pytest.mark.parametrize("limits", [(8192, 2_000_000), (7, 300), (3, 40)])
@pytest.mark.parametrize("best", [True, False])
def test_pooled_matching_in_rounds(spark, monkeypatch, limits, best):
    """Blocks and ranges of any size give what one loop over all predictions gives."""
    monkeypatch.setattr(matching, "BLOCK", limits[0])
    monkeypatch.setattr(matching, "RANGE", limits[1])
    pred, gold = rows(1, n=30), rows(2, docs=5, n=25) + [(9, "C", 0, "acme"), (9, "A", 1, "...")]
    want = collections.Counter()
    for t in "ABC":
        golds = sorted((d, s, v) for d, k, s, v in gold if k == t)
        used = set()
        for _, _, _, v in sorted(x for x in pred if x[1] == t):
            options = [(-recall(v, g[2]) if best else 0, i) for i, g in enumerate(golds) if recall(v, g[2]) >= 0.5 and i not in used]
            if options:
                used.add(min(options)[1])
        want[t] = len(used)
    got = evaluate.greedy_protocol(spark.createDataFrame(pred, SCHEMA), spark.createDataFrame(gold, SCHEMA), ["type"], best=best, pooled=True)
    n = collections.Counter(x[1] for x in pred), collections.Counter(x[1] for x in gold)
    assert {(r.type, r.tp, r.fp, r.fn) for r in got.collect()} == {(t, want[t], n[0][t] - want[t], n[1][t] - want[t]) for t in "ABC"}


def test_pooled_matching_of_nothing(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(3), SCHEMA)
    assert evaluate.greedy_protocol(none, none, ["type"], pooled=True).count() == 0
    assert {(r.tp, r.fp) for r in evaluate.greedy_protocol(some, none, ["type"], pooled=True).collect()} == {(0, n) for n in collections.Counter(x[1] for x in rows(3)).values()}


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_rounds_of_an_independent_set(spark, monkeypatch, tmp_path, limit):
    """A long chain, where every second node stays, and random edges, over many ranges."""
    monkeypatch.setattr(matching, "RANGE", limit)
    r = random.Random(4)
    for k, edges in enumerate(([(i, i + 1) for i in range(300)], [tuple(sorted(r.sample(range(200), 2))) for _ in range(400)])):
        gone = set()
        for b in sorted({y for _, y in edges}):
            if any(y == b and x not in gone for x, y in edges):
                gone.add(b)
        got = matching.dropped_in_order(spark.createDataFrame(edges, "a long, b long"), f"{tmp_path.as_uri()}/{k}")
        assert sorted(x.n for x in got.collect()) == sorted(gone)


@pytest.mark.parametrize("limits", [(8192, 2_000_000), (5, 30)])
def test_drop_similar_in_blocks(spark, monkeypatch, limits):
    monkeypatch.setattr(matching, "BLOCK", limits[0])
    monkeypatch.setattr(matching, "RANGE", limits[1])
    own = [(d, t, s, v, "x") for d, t, s, v in rows(7, docs=3, n=60)] + [(0, "A", 100, "..", "x"), (0, "A", 101, "", "x"), (0, "A", 102, "!", "x"), (1, "A", 103, "Acme, Corp", "x"), (1, "A", 104, "acme corp", "x")]
    want = []
    for d in range(3):
        kept = []
        for _, _, s, v, _ in sorted((x for x in own if x[0] == d), key=lambda x: x[2]):
            if all(0.4 * recall(v, k) + 0.6 * SequenceMatcher(None, norm(v), norm(k)).ratio() < 0.8 for k in kept):
                kept.append(v)
                want.append((d, s))
    got = entities.drop_similar(spark.createDataFrame(own, SCHEMA + ", n string").withColumnRenamed("n", "more"), "doc_id")
    assert sorted((r.doc_id, r.seq) for r in got.collect()) == sorted(want) and got.columns[-1] == "more"
    with pytest.raises(ValueError):
        entities.drop_similar(got, "doc_id", 0.5)


def test_bounds_never_cut(spark):
    r = random.Random(9)
    for _ in range(3000):
        x, y = ("".join(r.choice("abcd ") for _ in range(r.randrange(12))) for _ in range(2))
        ratio, least = SequenceMatcher(None, x, y).ratio(), r.random()
        assert S.letters_in_common(x, y) >= S.indel(x, y) - 1e-12 >= ratio - 2e-12
        assert S.sequence_at_least(x, y, least) == (ratio if ratio >= least else None)


@pytest.mark.parametrize("package", [False, True])
def test_combined_best_match(spark, package):
    """The best gold by the combined score, as a loop over all pairs finds it."""
    pred, gold = rows(5, docs=4, n=25) + [(0, "A", 90, ""), (0, "A", 91, "...")], rows(6, docs=4, n=25) + [(0, "A", 90, "")]
    want = {}
    for d, t, s, v in pred:
        scored = []
        for e, u, z, g in sorted(gold):
            if (e, u) == (d, t):
                ratio = SequenceMatcher(None, norm(v), norm(g)).ratio()
                edit = S.indel(norm(v), norm(g)) if package else ratio
                scored.append((-(0.4 * recall(v, g) + 0.3 * edit + 0.3 * ratio), z, g))
        best = min(scored, default=(0, 0, None))
        want[d, t, s] = (best[2], round(-best[0], 9)) if -best[0] >= 0.5 else (None, None)
    got = evaluate.best_match(spark.createDataFrame(pred, SCHEMA), spark.createDataFrame(gold, SCHEMA), score=S.COMBINED_PACKAGE if package else S.COMBINED)
    assert {(r.doc_id, r.type, r.seq): (r.gold, None if r.score is None else round(r.score, 9)) for r in got.collect()} == want


def test_combined_protocol_on_tables(spark):
    """The registered query against plain difflib on the smallest tables."""
    from quillspan.plans import registry

    sf = "/root/testdata/sf0.001"
    pred, gold = ([(r.doc_id, r.type, r.seq, r.value) for r in df.collect()] for df in pred_gold(spark, sf))
    golds = collections.defaultdict(list)
    for d, t, s, v in gold:
        golds[d, t].append((s, v))
    tp, fp, used = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for d, t, _, v in pred:
        best = max(((0.4 * recall(v, g) + 0.6 * SequenceMatcher(None, norm(v), norm(g)).ratio(), -s, g) for s, g in golds[d, t]), default=(0, 0, None))
        if best[0] >= 0.5:
            tp[t] += 1
            used[d, t].add(best[2])
        else:
            fp[t] += 1
    got = {r.type: r for r in registry.queries()["combined_protocol"](spark, sf).collect()}
    for t, r in got.items():
        n = sum(max(len(v) - len(used[k]), 0) for k, v in golds.items() if k[1] == t)
        assert (r.tp, r.fp, r.fn) == (tp[t], fp[t], n)


def loop_last(spans):
    kept = []
    for x in spans:
        if kept and x[1] is not None and kept[-1][2] is not None and x[1] < kept[-1][2]:
            if x[3] is not None and kept[-1][3] is not None and x[3] > kept[-1][3]:
                kept[-1] = x
        else:
            kept.append(x)
    return kept


def loop_any(spans):
    kept = []
    for x in spans:
        hit = next((y for y in kept if None not in (x[1], x[2], y[1], y[2]) and x[1] < y[2] and x[2] > y[1]), None)
        if hit is None:
            kept.append(x)
        elif x[3] is not None and hit[3] is not None and x[3] > hit[3]:
            kept.remove(hit)
            kept.append(x)
    return kept


@pytest.mark.parametrize("batch", [10_000, 3])
def test_overlaps_against_loops(spark, batch):
    r = random.Random(3)
    own = []
    for d in (0, 1, 2, None):
        for s in range(120):
            a = r.choice([None, *range(60)])
            own.append((d, s, a, r.choice([None, *[(a or 0) + k for k in range(-1, 9)]]), r.choice([None, 0.1, 0.5, 0.9]), "t"))
    df = spark.createDataFrame(own, "doc_id long, seq long, start int, end int, confidence double, type string").repartition(5)
    order = lambda x: (x[2] is not None, x[2] or 0, x[3] is not None, -(x[3] or 0), x[1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for f, loop in ((entities.resolve_last, loop_last), (entities.resolve_any, loop_any)):
            want = [(d, x[0]) for d in (0, 1, 2, None) for x in loop([(s, a, e, c) for _, s, a, e, c, _ in sorted((y for y in own if y[0] == d), key=order)])]
            assert sorted(((x.doc_id, x.seq) for x in f(df, "doc_id").collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_spans_in_one_document(spark):
    df = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("seq"), (F.col("id") * 3 % 250_000).cast("int").alias("start"), (F.col("id") * 3 % 250_000 + 1 + F.col("id") % 11).cast("int").alias("end"), (F.col("id") % 97 / 97).alias("confidence"))
    for f in (entities.resolve_last, entities.resolve_any):
        began = time.time()
        assert f(df, "doc_id").count() > 10_000
        assert time.time() - began < 20


def test_rule_spans_give_every_match(spark):
    from quillspan.operators import pipelines, providers

    texts = ["a@b.co then a@b.co, 10.0.0.1", None, "", "Ünï a@b.co 1234567890123456 x", "no"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pipelines.rule_spans(providers.RULES)(F.col("t")).alias("s")).collect()
    for r in got:
        t = texts[r.i] or ""
        want = [(k, m.group(), m.start(), m.end(), 0.9) for k, p in providers.RULES.items() for m in re.finditer(p, t, re.ASCII)]
        assert [tuple(x) for x in r.s] == want
