"""Resampling and exact tests against plain Python."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import evaluate


def weight(key: int, r: int, seed: int) -> int:
    m = (1 << 64) - 1
    z = (((key & m) * 1_000_003 + r + seed) & m) * 0x9E3779B97F4A7C15 & m
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & m
    z = (z ^ z >> 27) * 0x94D049BB133111EB & m
    u = ((z ^ z >> 31) >> 11) / 2**53
    return sum(u >= c for c in evaluate.POISSON)


def f1(rows):
    tp, fp, fn = (sum(x) for x in zip(*rows, strict=True))
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


@pytest.mark.parametrize("by", [["type"], []])
def test_bootstrap_against_loops(spark, by):
    r = random.Random(2)
    made = {}
    for k in (0, 1):
        made[k] = [(d, t, r.randrange(5), r.randrange(3), r.randrange(3)) for d in (*range(-3, 40), 2**62) for t in "AB" if r.random() < 0.8]
    schema = "doc_id long, type string, tp long, fp long, fn long"
    got = evaluate.bootstrap_f1(*(spark.createDataFrame(made[k], schema).repartition(4) for k in (0, 1)), by=by, replicas=60, level=0.9, seed=7).collect()
    for row in got:
        own = [[x for x in made[k] if not by or x[1] == row.type] for k in (0, 1)]
        keys = {x[0] for x in own[0] + own[1]}
        difference = sorted(f1([[weight(x[0], i, 7) * c for c in x[2:]] for x in own[0]]) - f1([[weight(x[0], i, 7) * c for c in x[2:]] for x in own[1]]) for i in range(60))
        a, b = (f1([x[2:] for x in own[k]]) for k in (0, 1))
        p = min(1.0, 2 * min(sum(d <= 0 for d in difference) + 1, sum(d >= 0 for d in difference) + 1) / 61)
        assert (row.f1_first, row.f1_second, row.difference, row.low, row.high, row.p) == pytest.approx((a, b, a - b, difference[2], difference[57], p))
        assert row.documents == len(keys)
    assert len(got) == (2 if by else 1)


def test_weights_are_poisson():
    w = evaluate.poisson_weights(np.arange(2000), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.25
    assert (evaluate.poisson_weights(np.array([5, -7]), 3, 1) == [[weight(k, r, 1) for r in range(3)] for k in (5, -7)]).all()


def test_signed_ranks_over_all_signs(spark):
    """The exact tail is what counting all signs gives, ties and zeros included."""
    r = random.Random(4)
    for _ in range(6):
        d = [r.choice([-3, -2, -1, 0, 1, 2, 4, 5]) / 2 for _ in range(r.randrange(2, 11))]
        x = sorted(abs(v) for v in d if v)
        if not x:
            continue
        rank = {v: sum(i + 1 for i, y in enumerate(x) if y == v) / x.count(v) for v in x}
        plus, minus = (sum(rank[abs(v)] for v in d if s * v > 0) for s in (1, -1))
        sums = [sum(s * rank[v] for s, v in zip(signs, x, strict=True)) for signs in itertools.product((0, 1), repeat=len(x))]
        want = min(1.0, 2 * sum(s <= min(plus, minus) for s in sums) / len(sums))
        got = evaluate.wilcoxon(spark.createDataFrame([(v, 0.0) for v in d], "a double, b double"), "a", "b").first()
        assert (got.n, got.w_plus, got.w_minus) == (len(x), plus, minus) and got.p == pytest.approx(want)


def test_exact_and_normal_agree_where_both_hold():
    rng = np.random.default_rng(3)
    n = 50
    d = rng.normal(0.3, 1, n)
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = int(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    z = (w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert evaluate._normal_tail(__import__("pyarrow").array([z]))[0].as_py() == pytest.approx(evaluate.signed_rank_tail([2 * int(r) for r in ranks], 2 * w), abs=0.005)


def test_many_differences_take_the_normal_form(spark):
    df = spark.range(200).select((F.col("id") % 7 - 2.5).alias("a"), F.lit(0.0).alias("b"))
    got = evaluate.wilcoxon(df, "a", "b").first()
    assert got.n == 200 and 0 < got.p < 1
