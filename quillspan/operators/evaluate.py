"""Matching and scoring protocols, error analysis, statistics.

Predictions and gold: rows (doc_id, type, seq, value[, start, end]).  Counts
are tp, fp, fn; ``prf`` turns them into guarded precision, recall and F1.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.similarity import COMBINED, COMBINED_PACKAGE, COVERAGE, JACCARD, RECALL, Measure
from quillspan.functions.text import context, simple, spaced
from quillspan.operators import combined, matching
from quillspan.sources.shared import fresh_folder, save


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and support to counts tp, fp, fn."""
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("support", F.col("tp") + F.col("fn"))


def set_counts(pred: DataFrame, gold: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """tp, fp, fn of distinct keys for each group of ``by`` (a subset of keys): one full outer join."""
    p = pred.select(*keys).distinct().withColumn("p", F.lit(1))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, keys, "full_outer")
    n = lambda c: F.count_if(c).alias
    return both.groupBy(*by).agg(n(F.col("p").isNotNull() & F.col("g").isNotNull())("tp"), n(F.col("g").isNull())("fp"), n(F.col("p").isNull())("fn"))


def exact(pred: DataFrame, gold: DataFrame, norm: Callable[[Column], Column] = spaced, by: list[str] | None = None, per_document: bool = True, types: list[str] | None = None) -> DataFrame:
    """Exact set match on type and normalised value, within documents unless they are pooled; with ``types`` a row for each of them, and for no other."""
    keys = (["doc_id"] if per_document else []) + ["type", "key"]
    own = [df.withColumn("key", norm(F.col("value"))) for df in (pred, gold)]
    if types is None:
        return prf(set_counts(*own, keys, by or []))
    counts = set_counts(*own, keys, ["type"])
    listed = pred.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return prf(F.broadcast(listed).join(counts, "type", "left").na.fill(0, ["tp", "fp", "fn"]))


def exact_spans(pred: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact match on document, type, start and end."""
    return prf(set_counts(pred, gold, ["doc_id", "type", "start", "end"], by or []))


def macro_by_document(pred: DataFrame, gold: DataFrame, documents: DataFrame, norm: Callable[[Column], Column]) -> DataFrame:
    """Mean over ``documents`` of each one's precision, recall and F1; one without any row counts 0."""
    own = [df.withColumn("key", norm(F.col("value"))) for df in (pred, gold)]
    each = prf(set_counts(*own, ["doc_id", "type", "key"], ["doc_id"]))
    each = documents.select("doc_id").join(each, "doc_id", "left")
    return each.agg(*[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("documents"))


def partial(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """Each prediction's best Jaccard in its type counts if it is ``least`` or more; recall may pass 1, as one gold can serve many."""
    best = _pairs(pred, gold, JACCARD).groupBy("doc_id", "type", "seq").agg(F.max("score").alias("s")).where(F.col("s") >= least)
    total = best.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("score"))
    # three tables of one row each
    sizes = pred.agg(F.count("*").alias("n_pred")).join(F.broadcast(gold.agg(F.count("*").alias("n_gold")))).join(F.broadcast(total))
    got = sizes.select("score", "n_pred", "n_gold", ratio(F.col("score"), F.col("n_pred")).alias("precision"), ratio(F.col("score"), F.col("n_gold")).alias("recall"))
    return got.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def coverage(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of the gold types that are predicted, per document; 1 without gold."""
    g = gold.select("doc_id", "type").distinct()
    hit = g.join(pred.select("doc_id", "type").distinct().withColumn("h", F.lit(1)), ["doc_id", "type"], "left")
    docs = pred.select("doc_id").union(gold.select("doc_id")).distinct()
    return docs.join(hit.groupBy("doc_id").agg((F.count("h") / F.count("*")).alias("coverage")), "doc_id", "left").select("doc_id", F.coalesce("coverage", F.lit(1.0)).alias("coverage"))


def consistency(pred: DataFrame) -> DataFrame:
    """Per document the mean, over types with several values, of 1 / distinct values; 1 if there is none."""
    t = pred.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count_distinct(spaced(F.col("value"))).alias("d"))
    return t.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("n") > 1, 1 / F.col("d"))), F.lit(1.0)).alias("consistency"))


def _pairs(pred: DataFrame, gold: DataFrame, score: Measure) -> DataFrame:
    """All predictions with the golds of their document and type; each value is prepared once, before the join."""
    g = gold.select("doc_id", "type", F.col("seq").alias("g_seq"), F.col("value").alias("gold"), score.prepare(F.col("value")).alias("_g"))
    return pred.withColumn("_p", score.prepare(F.col("value"))).join(g, ["doc_id", "type"]).withColumn("score", score.compare(F.col("_p"), F.col("_g"))).drop("_p", "_g")


def once(*tables: DataFrame) -> list[DataFrame]:
    """The tables, saved: where a protocol refers to them many times, what they come from is computed once."""
    path = fresh_folder(tables[0].sparkSession, "matching")
    return [save(df, f"{path}/{k}") for k, df in enumerate(tables)]


def _pairs_by_words(pred: DataFrame, gold: DataFrame, least: float, prepare: Callable[[Column], Column]) -> DataFrame:
    """The pairs of predictions and golds of a document and type of which the prediction has a share of ``least`` or more of the gold's words.

    Such a prediction has one of the gold's first n - ceil(least n) + 1 words
    in any order; the rarest come first, so few other pairs are met.
    """
    keys = ["doc_id", "type"]
    p, g = pred.withColumn("_p", prepare(F.col("value"))), gold.select(*keys, F.col("seq").alias("g_seq"), F.col("value").alias("gold"), prepare(F.col("value")).alias("_g"))
    has = p.select(*keys, "seq", F.explode("_p").alias("w"))
    often = g.select(*keys, F.explode("_g").alias("w")).union(has.select(*keys, "w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    ordered = g.select(*keys, "g_seq", F.explode("_g").alias("w")).join(often, [*keys, "w"]).groupBy(*keys, "g_seq").agg(F.sort_array(F.collect_list(F.struct("c", "w"))).alias("o"))
    first = ordered.select(*keys, "g_seq", F.explode(F.slice("o", F.lit(1), F.size("o") - F.ceil(least * F.size("o") - 1e-9).cast("int") + 1)).alias("x")).select(*keys, "g_seq", F.col("x.w").alias("w"))
    met = first.join(has, [*keys, "w"]).select(*keys, "g_seq", "seq").distinct()
    both = met.join(p, [*keys, "seq"]).join(g, [*keys, "g_seq"])
    return both.withColumn("score", F.size(F.array_intersect("_p", "_g")) / F.size("_g")).where(F.col("score") >= least).drop("_p", "_g")


def first_match(pred: DataFrame, gold: DataFrame, least: float = 0.5, score: Measure = RECALL) -> DataFrame:
    """(doc_id, type, seq, value, gold): the first gold, in order, that a prediction matches; null if none."""
    hit = _pairs(pred, gold, score).where(F.col("score") >= least).groupBy("doc_id", "type", "seq").agg(F.min_by("gold", "g_seq").alias("gold"))
    return pred.select("doc_id", "type", "seq", "value").join(hit, ["doc_id", "type", "seq"], "left")


def _best(pred: DataFrame, gold: DataFrame, least: float, score: Measure) -> DataFrame:
    """(doc_id, type, seq, gold, score) of the predictions that have a gold of ``least`` or more."""
    hit = _pairs(pred, gold, score).groupBy("doc_id", "type", "seq").agg(F.max_by(F.struct("gold", "score"), F.struct("score", -F.col("g_seq"))).alias("m")).where(F.col("m.score") >= least)
    return hit.select("doc_id", "type", "seq", "m.*")


def best_match(pred: DataFrame, gold: DataFrame, least: float = 0.5, score: Measure = COMBINED) -> DataFrame:
    """(doc_id, type, seq, value, gold, score): the best gold, the first of ties; null below ``least``."""
    own = pred.select("doc_id", "type", "seq", "value")
    if score in (COMBINED, COMBINED_PACKAGE) and least > 0:
        best = combined.best_combined(pred, gold, least, score is COMBINED_PACKAGE)
        return own.withColumn("text", F.when(F.col("seq").isNotNull(), simple(F.col("value")))).join(best, ["doc_id", "type", "text"], "left").drop("text")
    return own.join(_best(pred, gold, least, score), ["doc_id", "type", "seq"], "left")


def span_protocol(pred: DataFrame, gold: DataFrame, by: list[str], least: float = 0.7) -> DataFrame:
    """Best gold text by span coverage; each equal gold text can be used once.

    Closed form of the sequential rule: for each matched text, as many hits as
    the lesser of the predictions that chose it and the golds that have it.
    """
    chosen = _best(pred, gold, least, COVERAGE).groupBy("doc_id", "type", "gold").agg(F.count("*").alias("a"))
    have = gold.groupBy("doc_id", "type", F.col("value").alias("gold")).agg(F.count("*").alias("b"))
    tp = chosen.join(have, ["doc_id", "type", "gold"]).groupBy("doc_id", "type").agg(F.sum(F.least("a", "b")).alias("tp"))
    return _from_totals(tp, pred, gold, by)


def _from_totals(tp: DataFrame, pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    parts = pred.groupBy("doc_id", "type").agg(F.count("*").alias("n_pred")).join(gold.groupBy("doc_id", "type").agg(F.count("*").alias("n_gold")), ["doc_id", "type"], "full_outer").join(tp, ["doc_id", "type"], "left").na.fill(0)
    got = parts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("tp")).alias("fn"))
    return prf(got)


def shared_gold_protocol(pred: DataFrame, gold: DataFrame, by: list[str], least: float = 0.5, matcher=first_match) -> DataFrame:
    """A gold may serve many predictions; fn counts golds less the distinct texts matched."""
    m = matcher(pred, gold, least)
    p = m.groupBy("doc_id", "type").agg(F.count("gold").alias("tp"), F.count_if(F.col("gold").isNull()).alias("fp"), F.count_distinct("gold").alias("used"))
    g = gold.groupBy("doc_id", "type").agg(F.count("*").alias("n_gold"))
    both = p.join(g, ["doc_id", "type"], "full_outer").na.fill(0)
    return prf(both.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum(F.greatest(F.col("n_gold") - F.col("used"), F.lit(0))).alias("fn")))


def greedy_protocol(pred: DataFrame, gold: DataFrame, by: list[str], least: float = 0.5, best: bool = False, pooled: bool = False, score: Measure = RECALL) -> DataFrame:
    """Predictions in order take a gold that is still free: the first with ``least``, or the best (``best``); over all documents if ``pooled``.

    Pair scores are computed in a join, by shared words if the score is the
    recall of words; within a document the choice is a fold over its
    predictions.  Pooled, with the recall of words and ``least`` over 0, the
    choice is made in turns of predictions, with short lists of the golds
    still free (``matching``); other scores pooled are one fold a type.
    """
    if pooled and score is RECALL and least > 0:
        tp = matching.pooled_hits(pred, gold, ["type"], score.prepare(F.col("value")), least, best)
        parts = pred.groupBy("type").agg(F.count("*").alias("n_pred")).join(gold.groupBy("type").agg(F.count("*").alias("n_gold")), "type", "full_outer").join(tp, "type", "left").na.fill(0)
        got = parts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum(F.col("n_pred") - F.col("tp")).alias("fp"), F.sum(F.col("n_gold") - F.col("tp")).alias("fn"))
        return prf(got)
    if pooled:
        w = Window.partitionBy("type").orderBy("doc_id", "seq")
        pred, gold = (df.withColumn("seq", F.row_number().over(w)).withColumn("doc_id", F.lit(0).cast("long")) for df in (pred, gold))
    if not pooled and score is RECALL and least > 0:
        pred, gold = once(pred, gold)
    pairs = _pairs_by_words(pred, gold, least, score.prepare) if score is RECALL and least > 0 else _pairs(pred, gold, score).where(F.col("score") >= least)
    options = pairs.groupBy("doc_id", "type", "seq").agg(F.sort_array(F.collect_list(F.struct((-F.col("score") if best else F.lit(0.0)).alias("s"), "g_seq"))).alias("o"))
    group = options.groupBy("doc_id", "type").agg(F.sort_array(F.collect_list(F.struct("seq", "o"))).alias("p"))
    wanted = F.transform("p", lambda p: F.transform(p["o"], lambda x: x["g_seq"].cast("long")))
    tp = group.select("doc_id", "type", F.arrow_udf("int")(_take_free)(wanted).alias("tp"))
    return _from_totals(tp, pred, gold, by)


def _take_free(groups):
    """How many golds each group's predictions take, each the first of its list that is free."""
    import pyarrow as pa

    out = []
    for group in groups.to_pylist():
        used: set[int] = set()
        for wanted in group:
            free = next((g for g in wanted if g not in used), None)
            if free is not None:
                used.add(free)
        out.append(len(used))
    return pa.array(out, pa.int32())


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def token_scores(df: DataFrame, true: str, pred: str, outside: str = "O") -> DataFrame:
    """Macro precision, recall and F1 over labels seen in gold, and micro accuracy on gold labels other than ``outside``."""
    c = confusion(df, true, pred)
    t = c.groupBy("true").agg(F.sum("n").alias("gold"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("pred").alias("true")).agg(F.sum("n").alias("got"))
    each = t.join(p, "true", "left").select("true", "tp", "gold", ratio(F.col("tp"), F.coalesce("got", F.lit(0))).alias("p"), ratio(F.col("tp"), F.col("gold")).alias("r"))
    each = each.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    inside = F.col("true") != outside
    return each.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"), ratio(F.sum(F.when(inside, F.col("tp"))), F.sum(F.when(inside, F.col("gold")))).alias("micro"))


def aggregate_counts(counts: DataFrame, by: str = "type") -> DataFrame:
    """Per type and overall (scope) from tp, fp, fn rows, in one pass."""
    return prf(counts.rollup(by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn(by, F.coalesce(by, F.lit("ALL"))))


def dataset_statistics(docs: DataFrame, by: str) -> DataFrame:
    """Per split: documents, and least, greatest and mean length and entities."""
    n = F.char_length("text")
    return docs.groupBy(by).agg(F.count("*").alias("documents"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"), F.min("n_entities").alias("min_entities"), F.max("n_entities").alias("max_entities"), F.avg("n_entities").alias("mean_entities"))


def latency(df: DataFrame, by: str, seconds: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_s"), F.stddev_pop(seconds).alias("std_s"))


# Price per million tokens, input and output.
PRICES = [
    ("openai", "gpt-4-turbo", 10.0, 30.0), ("openai", "gpt-4o", 5.0, 15.0), ("openai", "gpt-4o-mini", 0.15, 0.6),
    ("anthropic", "claude-3-opus", 15.0, 75.0), ("anthropic", "claude-3-sonnet", 3.0, 15.0), ("anthropic", "claude-3-haiku", 0.25, 1.25),
    ("google", "gemini-1.5-pro", 3.5, 10.5), ("google", "gemini-1.5-flash", 0.35, 1.05),
]


def call_cost(calls: DataFrame, default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds cost from tokens and the price of (provider, model); unknown models cost the default."""
    prices = calls.sparkSession.createDataFrame(PRICES, "provider string, model string, p_in double, p_out double")
    priced = calls.join(F.broadcast(prices), ["provider", "model"], "left")
    cost = F.col("input_tokens") / 1e6 * F.coalesce("p_in", F.lit(default[0])) + F.col("output_tokens") / 1e6 * F.coalesce("p_out", F.lit(default[1]))
    return priced.withColumn("cost", cost).drop("p_in", "p_out")


def cost_summary(calls: DataFrame, budget: float = 100.0) -> DataFrame:
    """Calls and cost per provider and in all (provider ALL), with whether that is within the budget."""
    got = calls.rollup("provider").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    return got.select(F.coalesce("provider", F.lit("ALL")).alias("provider"), "calls", "cost", (F.col("cost") < budget).alias("within_budget"))


def errors(pred: DataFrame, gold: DataFrame, documents: DataFrame | None = None, least: float = 0.3) -> DataFrame:
    """(doc_id, error, type, predicted, expected[, context]): what didn't match exactly.

    An unmatched prediction is ``partial`` (best Jaccard over ``least`` with an
    unmatched gold of its type), else ``type_error`` (its value is gold of
    another type), else ``false_positive``; unmatched golds are
    ``false_negative``, those of a partial match too.
    """
    keys = ["doc_id", "type", "key"]
    p, g = (df.select("doc_id", "type", "seq", "value", spaced(F.col("value")).alias("key"), F.lit(k).alias("predicts")) for k, df in ((True, pred), (False, gold)))
    w = Window.partitionBy(*keys)
    matched = F.max("predicts").over(w) & F.max(~F.col("predicts")).over(w) & F.col("doc_id").isNotNull() & F.col("type").isNotNull() & F.col("key").isNotNull()
    # written once: what didn't match is read by three joins, which would each split and compare all values anew
    left = save(p.unionByName(g).withColumn("matched", matched).where("not matched").drop("matched"), f"{fresh_folder(pred.sparkSession, 'errors')}/left")
    wrong, missed = left.where("predicts").drop("predicts"), left.where("not predicts").drop("predicts")
    near = _pairs(wrong.select("doc_id", "type", "seq", "value"), missed, JACCARD).where(F.col("score") > least)
    near = near.groupBy("doc_id", "type", "seq").agg(F.max_by("gold", F.struct("score", -F.col("g_seq"))).alias("near"))
    other = wrong.alias("w").join(missed.alias("m"), (F.col("w.doc_id") == F.col("m.doc_id")) & (F.col("w.key") == F.col("m.key")) & (F.col("w.type") != F.col("m.type"))).groupBy("w.doc_id", "w.type", "w.seq").agg(F.min_by("m.value", "m.seq").alias("other"))
    bad = wrong.join(near, ["doc_id", "type", "seq"], "left").join(other, ["doc_id", "type", "seq"], "left")
    bad = bad.select("doc_id", F.when(F.col("near").isNotNull(), "partial").when(F.col("other").isNotNull(), "type_error").otherwise("false_positive").alias("error"), "type", F.col("value").alias("predicted"), F.coalesce("near", "other").alias("expected"))
    out = bad.unionByName(missed.select("doc_id", F.lit("false_negative").alias("error"), "type", F.lit(None).cast("string").alias("predicted"), F.col("value").alias("expected")))
    if documents is None:
        return out
    return out.join(documents.select("doc_id", "text"), "doc_id", "left").withColumn("context", context(F.coalesce("predicted", "expected"), F.col("text"))).drop("text")


def error_summary(found: DataFrame, samples: int = 5) -> DataFrame:
    """Per error: count and the first ``samples`` values; ``found`` is written once and read twice."""
    found = save(found, f"{fresh_folder(found.sparkSession, 'errors')}/found")
    w = Window.partitionBy("error").orderBy("doc_id", "type", F.coalesce("predicted", "expected"))
    few = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples).groupBy("error").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.coalesce("predicted", "expected").alias("v")))), lambda x: x["v"]).alias("samples"))
    return found.groupBy("error").agg(F.count("*").alias("n")).join(few, "error")


def errors_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("type").pivot("error", ["partial", "type_error", "false_positive", "false_negative"]).count().na.fill(0)


def error_patterns(found: DataFrame, least: int = 2, examples: int = 3) -> DataFrame:
    """(error, type, n, examples) of groups of ``least`` or more; ``found`` is written once and read twice."""
    found = save(found, f"{fresh_folder(found.sparkSession, 'errors')}/found")
    w = Window.partitionBy("error", "type").orderBy("doc_id", F.coalesce("predicted", "expected"))
    ex = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples).groupBy("error", "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", F.coalesce("predicted", "expected").alias("v")))), lambda x: x["v"]).alias("examples"))
    return found.groupBy("error", "type").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(ex, ["error", "type"])


def type_confusion(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(pred, true, n): types of predictions against the type of the last gold with that value, NOT_FOUND without one."""
    last = gold.groupBy("doc_id", spaced(F.col("value")).alias("key")).agg(F.max_by("type", "seq").alias("true"))
    got = pred.withColumn("key", spaced(F.col("value"))).join(last, ["doc_id", "key"], "left")
    return got.groupBy(F.col("type").alias("pred"), F.coalesce("true", F.lit("NOT_FOUND")).alias("true")).agg(F.count("*").alias("n"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, t, p, p05, p01) of paired values: mean difference over its standard error, two-sided."""
    d = F.col(a) - F.col(b)
    s = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    s = s.select("n", F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt("n"))).alias("t"))
    return s.withColumn("p", F.arrow_udf("double")(_t_tail)("t", F.col("n") - 1)).withColumn("p05", F.col("p") < 0.05).withColumn("p01", F.col("p") < 0.01)


def _t_tail(t, df):
    import pyarrow as pa

    return pa.array([None if x is None else student_tail(x, n) for x, n in zip(t.to_pylist(), df.to_pylist(), strict=True)], pa.float64())


def student_tail(t: float, df: float) -> float:
    """P(|T| > t): the regularised incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2), by its continued fraction."""
    import math

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        f = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f

    return beta(df / 2, 0.5, df / (df + t * t))


#: Differences up to which the signed-rank test is exact.
EXACT = 50


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, w, p): signed-rank sums with mean ranks on ties, zero differences left out.

    Two-sided; up to ``EXACT`` differences by the distribution of the rank sum
    over all signs of these ranks, beyond by the normal approximation with tie
    correction.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("x", F.abs("d"))
    # ranks from counts per size, added up within intervals of size, of which a double has a bounded number, and over them
    size = d.groupBy("x").agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("plus")).withColumn("_b", F.floor(F.log2("x") * 64))
    totals = size.groupBy("_b").agg(F.sum("c").alias("_n"))
    totals = totals.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    upto = F.col("_base") + F.sum("c").over(Window.partitionBy("_b").orderBy("x"))
    size = size.join(F.broadcast(totals), "_b").withColumn("rank", upto - (F.col("c") - 1) / 2)
    s = size.agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("plus"))).alias("w_minus"), F.sum(F.col("c") ** 3 - F.col("c")).alias("ties"))
    few = size.orderBy("rank").limit(EXACT).agg(F.collect_list(F.struct((2 * F.col("rank")).cast("long").alias("r"), "c")).alias("ranks"))  # all of them if they are few
    s = s.join(F.broadcast(few))
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = (w - n * (n + 1) / 4) / F.sqrt(var)
    exact = F.arrow_udf("double")(_signed_rank_tail)(F.when(n <= EXACT, F.col("ranks")), (2 * w).cast("long"))
    return s.select("n", "w_plus", "w_minus", w.alias("w"), F.when(n <= EXACT, exact).when(var > 0, F.arrow_udf("double")(_normal_tail)(z)).alias("p"))


def signed_rank_tail(ranks: list[int], w: int) -> float:
    """min(1, 2 P(W <= w)), W the sum of ``ranks`` (whole numbers) with fair coins for signs."""
    ways = [1]
    for r in ranks:
        old, ways = ways, ways + [0] * r
        for k, n in enumerate(old):
            ways[k + r] += n
    return min(1.0, 2 * sum(ways[: w + 1]) / 2 ** len(ranks))


def _signed_rank_tail(ranks, w):
    import pyarrow as pa

    return pa.array([None if x is None else signed_rank_tail([i["r"] for i in x for _ in range(i["c"])], k) for x, k in zip(ranks.to_pylist(), w.to_pylist(), strict=True)], pa.float64())


#: Distribution function of the Poisson distribution of mean 1 at 0, 1, 2, ...; beyond its end no more weight is given.
POISSON = tuple(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))


def poisson_weights(keys, replicas: int, seed: int = 0):
    """A weight for each key (longs) and replica, of a Poisson distribution of mean 1: a function of the two and ``seed``, so it is the same wherever a row is."""
    import numpy as np

    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        z = (np.asarray(keys).astype(np.uint64)[:, None] * np.uint64(1_000_003) + np.arange(replicas, dtype=np.uint64)[None, :] + np.uint64(seed)) * mix
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return np.searchsorted(POISSON, (z >> np.uint64(11)).astype(float) / 2.0**53, "right")


def bootstrap_f1(first: DataFrame, second: DataFrame, by: list[str], key: str = "doc_id", replicas: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(by..., documents, f1_first, f1_second, difference, low, high, p): is the difference of two systems' F1 more than chance?

    ``first`` and ``second``: counts (key, by..., tp, fp, fn) of documents; a
    document that one of them lacks has no counts there; ``key`` is a whole
    number.  Poisson bootstrap: a replica gives each document a weight, so all
    replicas are sums over one pass, added up in the tasks before anything is
    shuffled.  ``low`` and ``high`` are the nearest ranks of the differences
    at (1 - level) / 2 from either end; p is twice the smaller share of
    replicas on one side of zero, each counted with one more, 1 at most.
    """
    counts = ("tp", "fp", "fn")
    sides = [df.groupBy(key, *by).agg(*[F.sum(c).alias(f"{c}{k}") for c in counts]) for k, df in enumerate((first, second))]
    names = [f"{c}{k}" for k in (0, 1) for c in counts]
    both = sides[0].join(sides[1], [key, *by], "full_outer").na.fill(0, names)
    groups = both.select(*by, F.col(key).cast("long").alias("_k"), F.array(*[F.col(n).cast("double") for n in names]).alias("_c"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[tuple, object] = {}
        for batch in batches:
            values = np.array(batch.column(len(by) + 1).flatten()).reshape(-1, len(names))
            keys = batch.column(len(by)).to_numpy(zero_copy_only=False)
            labels = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(keys)
            where: dict[tuple, list[int]] = {}
            for i, g in enumerate(labels):
                where.setdefault(g, []).append(i)
            for g, rows in where.items():
                total = sums.setdefault(g, np.zeros((replicas + 1, len(names))))
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    total[0] += values[part].sum(0)
                    total[1:] += poisson_weights(keys[part], replicas, seed).T @ values[part]
        for g, total in sums.items():
            yield pa.RecordBatch.from_pylist([{**dict(zip(by, g, strict=True)), "_r": r, **dict(zip(names, map(float, row), strict=True))} for r, row in enumerate(total)], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    kind = StructType([*(StructField(f.name, f.dataType) for f in groups.schema if f.name in by), StructField("_r", IntegerType()), *(StructField(n, DoubleType()) for n in names)])
    schema = to_arrow_schema(kind)
    sums = groups.mapInArrow(run, kind).groupBy(*by, "_r").agg(*[F.sum(n).alias(n) for n in names])
    f1 = [ratio(2 * F.col(f"tp{k}"), 2 * F.col(f"tp{k}") + F.col(f"fp{k}") + F.col(f"fn{k}")) for k in (0, 1)]
    each = sums.select(*by, "_r", f1[0].alias("a"), f1[1].alias("b"))
    own = F.max(F.when(F.col("_r") == 0, F.struct("a", "b")))
    got = each.groupBy(*by).agg(own.alias("o"), F.sort_array(F.collect_list(F.when(F.col("_r") > 0, F.col("a") - F.col("b")))).alias("d"))
    rank = max(1, round((1 - level) / 2 * replicas))
    side = lambda keep: F.size(F.filter("d", keep)) + 1
    p = F.least(F.lit(1.0), 2 * F.least(side(lambda x: x <= 0), side(lambda x: x >= 0)) / (replicas + 1))
    sizes = both.groupBy(*by).agg(F.count("*").alias("documents"))
    got = got.select(*by, F.col("o.a").alias("f1_first"), F.col("o.b").alias("f1_second"), (F.col("o.a") - F.col("o.b")).alias("difference"), F.get("d", F.lit(rank - 1)).alias("low"), F.get("d", F.lit(replicas - rank)).alias("high"), p.alias("p"))
    return got.join(sizes, by) if by else got.join(F.broadcast(sizes))


def _normal_tail(z):
    import math

    import pyarrow as pa

    return pa.array([None if x is None else math.erfc(abs(x) / math.sqrt(2)) for x in z.to_pylist()], pa.float64())


def rank_models(results: DataFrame, by: str = "f1") -> DataFrame:
    """Models from best to worst, the first of ties first (seq)."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), "seq")))


def evaluate_models(pred: DataFrame, gold: DataFrame, models: list[str], norm: Callable[[Column], Column] = spaced, failed: DataFrame | None = None) -> DataFrame:
    """Each of ``models`` with its exact scores and rank, from predictions with a model column.

    ``failed`` (model, doc_id): documents that a model could not be asked about;
    they are left out of its counts.  The models are a stated, small list.
    """
    names = F.array(*map(F.lit, models))
    gold = gold.select("*", F.explode(names).alias("model"))
    pred = pred.where(F.col("model").isin(models))
    if failed is not None:
        pred, gold = (df.join(failed.select("model", "doc_id").distinct(), ["model", "doc_id"], "left_anti") for df in (pred, gold))
    own = [df.withColumn("key", norm(F.col("value"))) for df in (pred, gold)]
    counts = set_counts(*own, ["model", "doc_id", "type", "key"], ["model"])
    listed = pred.sparkSession.createDataFrame(list(enumerate(models)), "seq int, model string")
    return rank_models(prf(F.broadcast(listed).join(counts, "model", "left").na.fill(0, ["tp", "fp", "fn"]))).drop("seq")


def compare_datasets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Models in both results with the difference of their F1."""
    return a.select("model", F.col("f1").alias("f1_a")).join(b.select("model", F.col("f1").alias("f1_b")), "model").withColumn("difference", F.col("f1_a") - F.col("f1_b"))


def top_types(per_type: DataFrame, n: int = 10, by: str = "f1", supported: bool = True) -> DataFrame:
    df = per_type.where("support > 0") if supported else per_type
    return df.orderBy(F.col(by).desc(), "type").limit(n)


def compute_metrics(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(metric, value): exact and partial scores, coverage and consistency in one table."""
    e = exact(pred, gold).select(F.explode(F.create_map(F.lit("exact_precision"), F.col("precision"), F.lit("exact_recall"), F.col("recall"), F.lit("exact_f1"), F.col("f1"))).alias("metric", "value"))
    p = partial(pred, gold).select(F.explode(F.create_map(F.lit("partial_precision"), F.col("precision"), F.lit("partial_recall"), F.col("recall"), F.lit("partial_f1"), F.col("f1"))).alias("metric", "value"))
    c = coverage(pred, gold).agg(F.avg("coverage").alias("value")).select(F.lit("coverage").alias("metric"), "value")
    k = consistency(pred).agg(F.avg("consistency").alias("value")).select(F.lit("consistency").alias("metric"), "value")
    return e.union(p).union(c).union(k)
