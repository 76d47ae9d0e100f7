"""Queries that score predictions against gold, and what is reported of it.

Predictions are the sentences of conversations, typed by role; gold is derived
from them: every fourth is left out, every third is changed.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from quillspan.functions.numbers import rounded
from quillspan.functions import similarity as S
from quillspan.functions import text as T
from quillspan.operators import bio, evaluate
from quillspan.plans.registry import query
from quillspan.plans.text_queries import SIMPLE, SPACED, table

BASE = r"""WITH p0 AS (SELECT conv_id AS doc_id, role AS type, turn, list_filter(list_transform(regexp_extract_all(text, '(?s)(?:.*?[.!?]\s+|.+)'), lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v <> '') AS s FROM conversations),
pred AS (SELECT doc_id, type, turn * 1000 + unnest(range(len(s))) AS seq, unnest(s) AS value FROM p0),
gold AS (SELECT doc_id, CASE WHEN seq % 7 = 5 THEN 'other' ELSE type END AS type, seq, CASE WHEN seq % 3 = 1 THEN value || ' x' WHEN seq % 3 = 2 THEN 'y ' || value ELSE value END AS value FROM pred WHERE seq % 4 <> 3)"""
PRF = "tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, tp + fn AS support"
KEY = SPACED.format("value")
WORDS = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
PW, GW = WORDS.format(SPACED.format("p.value")), WORDS.format(SPACED.format("g.value"))
JACCARD = f"CASE WHEN len({PW}) = 0 AND len({GW}) = 0 THEN 0 ELSE len(list_intersect({PW}, {GW})) / (len({PW}) + len({GW}) - len(list_intersect({PW}, {GW}))) END"
RECALL = f"CASE WHEN len({GW}) = 0 THEN 0 ELSE len(list_intersect({PW}, {GW})) / len({GW}) END"
COVERAGE = f"CASE WHEN contains({SPACED.format('p.value')}, {SPACED.format('g.value')}) THEN 1.0 ELSE {RECALL} END"


#: Word lists are made once for each value, before the join.
_LISTS = f"""{BASE.replace('WITH', 'WITH RECURSIVE', 1)}, ps AS (SELECT doc_id, type, seq, value, {WORDS.format(SIMPLE.format('value'))} AS w FROM pred), gs AS (SELECT doc_id, type, seq, value, {WORDS.format(SIMPLE.format('value'))} AS w FROM gold)"""
_HIT = "CASE WHEN len(g.w) = 0 THEN 0 ELSE len(list_intersect(p.w, g.w)) / len(g.w) END"


def _shared_sql(chosen):
    return f"""{_LISTS}, m AS (SELECT p.doc_id, p.type, p.seq, {chosen} AS gold FROM ps p JOIN gs g ON p.doc_id = g.doc_id AND p.type = g.type WHERE {_HIT} >= 0.5 GROUP BY ALL),
a AS (SELECT p.doc_id, p.type, count(m.gold) AS tp, count(*) FILTER (m.gold IS NULL) AS fp, count(DISTINCT m.gold) AS used FROM pred p LEFT JOIN m ON p.doc_id = m.doc_id AND p.type = m.type AND p.seq = m.seq GROUP BY 1, 2), b AS (SELECT doc_id, type, count(*) AS n FROM gold GROUP BY 1, 2),
c AS (SELECT coalesce(a.type, b.type) AS type, CAST(sum(coalesce(tp, 0)) AS BIGINT) AS tp, CAST(sum(coalesce(fp, 0)) AS BIGINT) AS fp, CAST(sum(greatest(coalesce(n, 0) - coalesce(used, 0), 0)) AS BIGINT) AS fn FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.type = b.type GROUP BY 1)
SELECT type, {PRF} FROM c"""


def _greedy_sql(order, pooled=False):
    """One step of the recursion gives one prediction of every group the first free gold of its list."""
    own = f", {', '.join(f'{t} AS (SELECT 0 AS doc_id, type, row_number() OVER (PARTITION BY type ORDER BY doc_id, seq) AS seq, value, w FROM {s})' for t, s in (('pp', 'ps'), ('gg', 'gs')))}" if pooled else ", pp AS (SELECT * FROM ps), gg AS (SELECT * FROM gs)"
    free = "list_filter(n.o, lambda x: NOT list_contains(w.used, x))"
    return f"""{_LISTS}{own}, o AS (SELECT p.doc_id, p.type, p.seq, list(g.seq ORDER BY {order}) AS o FROM pp p JOIN gg g ON p.doc_id = g.doc_id AND p.type = g.type WHERE {_HIT} >= 0.5 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY seq) AS i FROM o),
w AS (SELECT DISTINCT doc_id, type, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM o UNION ALL
  SELECT w.doc_id, w.type, n.i, CASE WHEN len({free}) > 0 THEN list_append(w.used, {free}[1]) ELSE w.used END FROM w JOIN n ON w.doc_id = n.doc_id AND w.type = n.type AND n.i = w.i + 1),
t AS (SELECT type, sum(k) AS tp FROM (SELECT doc_id, type, len(arg_max(used, i)) AS k FROM w GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT coalesce(p.type, g.type) AS type, coalesce(p.n, 0) AS np, coalesce(g.n, 0) AS ng FROM (SELECT type, count(*) AS n FROM pred GROUP BY 1) p FULL JOIN (SELECT type, count(*) AS n FROM gold GROUP BY 1) g ON p.type = g.type),
c AS (SELECT s.type, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(np - coalesce(tp, 0) AS BIGINT) AS fp, CAST(ng - coalesce(tp, 0) AS BIGINT) AS fn FROM s LEFT JOIN t USING (type))
SELECT type, {PRF} FROM c"""


def pred_gold(spark, sf_dir, saved=False):
    s = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    pred = s.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("type"), (F.col("turn") * 1000 + F.col("i")).alias("seq"), F.col("s.text").alias("value"))
    if saved:
        (pred,) = evaluate.once(pred)
    q, v = F.col("seq"), F.col("value")
    gold = pred.where(q % 4 != 3).select("doc_id", F.when(q % 7 == 5, "other").otherwise(F.col("type")).alias("type"), "seq", F.when(q % 3 == 1, F.concat(v, F.lit(" x"))).when(q % 3 == 2, F.concat(F.lit("y "), v)).otherwise(v).alias("value"))
    return pred, gold


def scores(df, *keep):
    return df.select(*keep, "tp", "fp", "fn", *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _exact_sql(keys, by):
    j = " AND ".join(f"p.{k} = g.{k}" for k in keys)
    group = f"GROUP BY {by}" if by else ""
    return f"""{BASE}, p AS (SELECT DISTINCT {', '.join('{} AS key'.format(KEY) if k == 'key' else k for k in keys)} FROM pred), g AS (SELECT DISTINCT {', '.join('{} AS key'.format(KEY) if k == 'key' else k for k in keys)} FROM gold),
c AS (SELECT {f'coalesce(p.{by}, g.{by}) AS {by},' if by else ''} count(*) FILTER (p.key IS NOT NULL AND g.key IS NOT NULL) AS tp, count(*) FILTER (g.key IS NULL) AS fp, count(*) FILTER (p.key IS NULL) AS fn FROM p FULL JOIN g ON {j} {'GROUP BY 1' if by else ''})
SELECT {f'{by},' if by else ''} {PRF} FROM c"""


@query("exact_metrics", _exact_sql(["doc_id", "type", "key"], "type"))
def exact_metrics(spark, sf_dir):
    return scores(evaluate.exact(*pred_gold(spark, sf_dir), by=["type"]), "type")


@query("exact_pooled", _exact_sql(["type", "key"], ""))
def exact_pooled(spark, sf_dir):
    return scores(evaluate.exact(*pred_gold(spark, sf_dir), per_document=False))


@query(
    "exact_spans",
    f"""{BASE}, p AS (SELECT DISTINCT doc_id, type, seq AS start, seq + length(value) AS e FROM pred), g AS (SELECT DISTINCT doc_id, type, seq AS start, seq + length(value) AS e FROM gold),
c AS (SELECT count(*) FILTER (p.e IS NOT NULL AND g.e IS NOT NULL) AS tp, count(*) FILTER (g.e IS NULL) AS fp, count(*) FILTER (p.e IS NULL) AS fn FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.type = g.type AND p.start = g.start AND p.e = g.e) SELECT {PRF} FROM c""",
)
def exact_spans(spark, sf_dir):
    own = [df.select("doc_id", "type", F.col("seq").alias("start"), (F.col("seq") + F.char_length("value")).alias("end")) for df in pred_gold(spark, sf_dir)]
    return scores(evaluate.exact_spans(*own))


@query(
    "partial_metrics",
    f"""{BASE}, b AS (SELECT p.doc_id, p.type, p.seq, max({JACCARD}) AS s FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.type = g.type GROUP BY ALL)
SELECT round(sum(s), 6) AS score, (SELECT count(*) FROM pred) AS n_pred, (SELECT count(*) FROM gold) AS n_gold FROM b WHERE s >= 0.5""",
)
def partial_metrics(spark, sf_dir):
    return evaluate.partial(*pred_gold(spark, sf_dir)).select(rounded("score", 6).alias("score"), "n_pred", "n_gold")


@query(
    "coverage_consistency",
    f"""{BASE}, g AS (SELECT DISTINCT doc_id, type FROM gold), h AS (SELECT g.doc_id, avg(CAST(p.type IS NOT NULL AS INT)) AS c FROM g LEFT JOIN (SELECT DISTINCT doc_id, type FROM pred) p ON g.doc_id = p.doc_id AND g.type = p.type GROUP BY 1),
t AS (SELECT doc_id, type, count(*) AS n, count(DISTINCT {KEY}) AS d FROM pred GROUP BY 1, 2), k AS (SELECT doc_id, coalesce(avg(1 / d) FILTER (n > 1), 1) AS k FROM t GROUP BY 1)
SELECT k.doc_id, round(coalesce(h.c, 1), 6) AS coverage, round(k.k, 6) AS consistency FROM k LEFT JOIN h ON k.doc_id = h.doc_id""",
)
def coverage_consistency(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    return evaluate.consistency(pred).join(evaluate.coverage(pred, gold), "doc_id").select("doc_id", rounded("coverage", 6).alias("coverage"), rounded("consistency", 6).alias("consistency"))


@query(
    "match_first",
    f"""{BASE}, m AS (SELECT p.doc_id, p.type, p.seq, arg_min(g.value, g.seq) AS gold FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.type = g.type WHERE {RECALL} >= 0.5 GROUP BY ALL)
SELECT p.doc_id, p.type, p.seq, m.gold FROM pred p LEFT JOIN m ON p.doc_id = m.doc_id AND p.type = m.type AND p.seq = m.seq""",
)
def match_first(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    return evaluate.first_match(pred, gold, 0.5, S.RECALL_SPACED).drop("value")


_SPAN = f"""{BASE}, m AS (SELECT p.doc_id, p.type, p.seq, arg_max(g.value, row({COVERAGE}, -g.seq)) AS gold, max({COVERAGE}) AS s FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.type = g.type GROUP BY ALL),
a AS (SELECT doc_id, type, gold, count(*) AS a FROM m WHERE s >= 0.7 GROUP BY ALL), b AS (SELECT doc_id, type, value AS gold, count(*) AS b FROM gold GROUP BY ALL),
t AS (SELECT type, sum(least(a, b)) AS tp FROM a JOIN b USING (doc_id, type, gold) GROUP BY 1),
n AS (SELECT coalesce(p.type, g.type) AS type, coalesce(p.n, 0) AS np, coalesce(g.n, 0) AS ng FROM (SELECT type, count(*) AS n FROM pred GROUP BY 1) p FULL JOIN (SELECT type, count(*) AS n FROM gold GROUP BY 1) g ON p.type = g.type),
c AS (SELECT n.type, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(np - coalesce(tp, 0) AS BIGINT) AS fp, CAST(ng - coalesce(tp, 0) AS BIGINT) AS fn FROM n LEFT JOIN t USING (type))"""


@query("span_protocol", f"{_SPAN} SELECT type, {PRF} FROM c")
def span_protocol(spark, sf_dir):
    return scores(evaluate.span_protocol(*pred_gold(spark, sf_dir), by=["type"]), "type")


@query(
    "span_rollup",
    f"{_SPAN}, r AS (SELECT type, tp, fp, fn FROM c UNION ALL SELECT 'ALL', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c) SELECT type, {PRF} FROM r",
)
def span_rollup(spark, sf_dir):
    return scores(evaluate.aggregate_counts(evaluate.span_protocol(*pred_gold(spark, sf_dir), by=["type"])), "type")


@query("shared_gold_protocol", _shared_sql("arg_min(g.value, g.seq)"))
def shared_gold(spark, sf_dir):
    return scores(evaluate.shared_gold_protocol(*pred_gold(spark, sf_dir), by=["type"]), "type")


@query("shared_gold_best", _shared_sql(f"first(g.value ORDER BY {_HIT} DESC, g.seq)"))
def shared_gold_best(spark, sf_dir):
    best = functools.partial(evaluate.best_match, score=S.RECALL)
    return scores(evaluate.shared_gold_protocol(*pred_gold(spark, sf_dir), by=["type"], matcher=best), "type")


@query("combined_protocol")
def combined_protocol(spark, sf_dir):
    """Best gold by the combined score of words and sequence: no SQL, tested against plain difflib."""
    return scores(evaluate.shared_gold_protocol(*pred_gold(spark, sf_dir, saved=True), by=["type"], matcher=evaluate.best_match), "type")


@query("greedy_protocol", _greedy_sql("g.seq"))
def greedy(spark, sf_dir):
    return scores(evaluate.greedy_protocol(*pred_gold(spark, sf_dir), by=["type"]), "type")


@query("greedy_best_protocol", _greedy_sql(f"{_HIT} DESC, g.seq"))
def greedy_best(spark, sf_dir):
    return scores(evaluate.greedy_protocol(*pred_gold(spark, sf_dir), by=["type"], best=True), "type")


@query("greedy_pooled_protocol", _greedy_sql(f"{_HIT} DESC, g.seq", pooled=True))
def greedy_pooled(spark, sf_dir):
    return scores(evaluate.greedy_protocol(*pred_gold(spark, sf_dir), by=["type"], best=True, pooled=True), "type")


_LISTED = ["user", "assistant", "none of these", "system", "tool"]


@query(
    "exact_listed_types",
    f"""{_exact_sql(["doc_id", "type", "key"], "type").rpartition("SELECT type,")[0]}, l AS (SELECT unnest({_LISTED}) AS type), d AS (SELECT l.type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM l LEFT JOIN c ON l.type = c.type) SELECT type, {PRF} FROM d""",
)
def exact_listed_types(spark, sf_dir):
    return scores(evaluate.exact(*pred_gold(spark, sf_dir), types=_LISTED), "type")


@query(
    "macro_by_document",
    rf"""{BASE}, p AS (SELECT DISTINCT doc_id, type, regexp_replace({KEY}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g') AS key FROM pred), g AS (SELECT DISTINCT doc_id, type, regexp_replace({KEY}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g') AS key FROM gold),
c AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, count(*) FILTER (p.key IS NOT NULL AND g.key IS NOT NULL) AS tp, count(*) FILTER (g.key IS NULL) AS fp, count(*) FILTER (p.key IS NULL) AS fn FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.type = g.type AND p.key = g.key GROUP BY 1)
SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 6) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 6) AS recall, round(avg(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f1, count(*) AS documents FROM c""",
)
def macro_by_document(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    got = evaluate.macro_by_document(pred, gold, pred.select("doc_id").distinct(), T.wordy)
    return got.select(*[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1")], "documents")


_ERR = f"""{BASE}, pk AS (SELECT *, {KEY} AS key FROM pred), gk AS (SELECT *, {KEY} AS key FROM gold),
w AS (SELECT * FROM pk WHERE NOT EXISTS (SELECT 1 FROM gk WHERE gk.doc_id = pk.doc_id AND gk.type = pk.type AND gk.key = pk.key)), m AS (SELECT * FROM gk WHERE NOT EXISTS (SELECT 1 FROM pk WHERE gk.doc_id = pk.doc_id AND gk.type = pk.type AND gk.key = pk.key)),
n AS (SELECT p.doc_id, p.type, p.seq, arg_max(g.value, row({JACCARD}, -g.seq)) AS near FROM w p JOIN m g ON p.doc_id = g.doc_id AND p.type = g.type WHERE {JACCARD} > 0.3 GROUP BY ALL),
o AS (SELECT w.doc_id, w.type, w.seq, arg_min(m.value, m.seq) AS other FROM w JOIN m ON w.doc_id = m.doc_id AND w.key = m.key AND w.type <> m.type GROUP BY ALL),
err AS (SELECT w.doc_id, CASE WHEN near IS NOT NULL THEN 'partial' WHEN other IS NOT NULL THEN 'type_error' ELSE 'false_positive' END AS error, w.type, w.value AS predicted, coalesce(near, other) AS expected FROM w LEFT JOIN n USING (doc_id, type, seq) LEFT JOIN o USING (doc_id, type, seq)
  UNION ALL SELECT doc_id, 'false_negative', type, NULL, value FROM m)"""


@query("error_analysis", f"{_ERR} SELECT * FROM err")
def error_analysis(spark, sf_dir):
    return evaluate.errors(*pred_gold(spark, sf_dir))


@query("error_by_type", f"{_ERR} SELECT type, count(*) FILTER (error = 'partial') AS partial, count(*) FILTER (error = 'type_error') AS type_error, count(*) FILTER (error = 'false_positive') AS false_positive, count(*) FILTER (error = 'false_negative') AS false_negative FROM err GROUP BY 1")
def error_by_type(spark, sf_dir):
    return evaluate.errors_by_type(evaluate.errors(*pred_gold(spark, sf_dir)))


@query("error_patterns", f"{_ERR} SELECT error, type, count(*) AS n, array_to_string(list(coalesce(predicted, expected) ORDER BY doc_id, coalesce(predicted, expected))[1:3], '|') AS examples FROM err GROUP BY 1, 2 HAVING count(*) >= 2")
def error_patterns(spark, sf_dir):
    return evaluate.error_patterns(evaluate.errors(*pred_gold(spark, sf_dir))).withColumn("examples", F.array_join("examples", "|"))


@query("error_samples", f"{_ERR}, r AS (SELECT error, coalesce(predicted, expected) AS v, row_number() OVER (PARTITION BY error ORDER BY doc_id, type, coalesce(predicted, expected)) AS r, count(*) OVER (PARTITION BY error) AS n FROM err) SELECT error, n, string_agg(v, '|' ORDER BY r) AS samples FROM r WHERE r <= 5 GROUP BY 1, 2")
def error_samples(spark, sf_dir):
    return evaluate.error_summary(evaluate.errors(*pred_gold(spark, sf_dir))).withColumn("samples", F.array_join("samples", "|"))


@query(
    "type_confusion",
    f"""{BASE}, l AS (SELECT doc_id, {KEY} AS key, arg_max(type, seq) AS t FROM gold GROUP BY 1, 2) SELECT p.type AS pred, coalesce(l.t, 'NOT_FOUND') AS "true", count(*) AS n FROM pred p LEFT JOIN l ON p.doc_id = l.doc_id AND {SPACED.format('p.value')} = l.key GROUP BY 1, 2""",
)
def type_confusion(spark, sf_dir):
    return evaluate.type_confusion(*pred_gold(spark, sf_dir))


@query(
    "token_scores",
    """WITH c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT t, sum(n) AS g, coalesce(sum(n) FILTER (t = p), 0) AS tp FROM c GROUP BY 1), q AS (SELECT p, sum(n) AS got FROM c GROUP BY 1),
e AS (SELECT t, tp, g, CASE WHEN coalesce(got, 0) > 0 THEN tp / got ELSE 0 END AS p, tp / g AS r FROM t LEFT JOIN q ON t.t = q.p), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM e)
SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, round(sum(tp) FILTER (t <> 0) / sum(g) FILTER (t <> 0), 6) AS micro FROM f""",
)
def token_scores(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    got = evaluate.token_scores(df, "q", "t", "0")
    return got.select(*[rounded(c, 6).alias(c) for c in got.columns])


@query(
    "similarity_scores",
    f"""{BASE} SELECT p.doc_id, p.type, p.seq, round({JACCARD}, 6) AS jaccard, round({RECALL}, 6) AS recall, round({COVERAGE}, 6) AS coverage, round((10 - p.seq % 10) / (10 + p.seq % 10), 6) AS iou FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.seq = g.seq""",
)
def similarity_scores(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    both = pred.join(gold.select("doc_id", "seq", F.col("value").alias("gold")), ["doc_id", "seq"])
    v, g, m = F.col("value"), F.col("gold"), F.col("seq") % 10
    return both.select("doc_id", "type", "seq", rounded(S.jaccard(v, g), 6).alias("jaccard"), rounded(S.RECALL_SPACED(v, g), 6).alias("recall"), rounded(S.span_coverage(v, g), 6).alias("coverage"), rounded(S.span_iou(F.lit(0), F.lit(10), m, m + 10), 6).alias("iou"))


@query("similarity_combined")
def similarity_combined(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    both = pred.join(gold.select("doc_id", "seq", F.col("value").alias("gold")), ["doc_id", "seq"])
    return both.select("doc_id", "seq", rounded(S.combined(F.col("value"), F.col("gold"), package=True), 6).alias("combined"))


@query("latency_stats", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_s, round(stddev_pop(value), 6) AS std_s FROM events GROUP BY 1")
def latency_stats(spark, sf_dir):
    df = evaluate.latency(table(spark, sf_dir, "events"), "event_type", "value")
    return df.select("event_type", "n", rounded("mean_s", 6).alias("mean_s"), rounded("std_s", 6).alias("std_s"))


@query(
    "cost_by_provider",
    """WITH c AS (SELECT CASE event_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'google' ELSE 'none' END AS provider, event_id % 1000 AS i, user_id % 500 AS o FROM events),
k AS (SELECT provider, CASE provider WHEN 'openai' THEN i / 1e6 * 5.0 + o / 1e6 * 15.0 WHEN 'google' THEN i / 1e6 * 0.35 + o / 1e6 * 1.05 ELSE 0 END AS cost FROM c)
SELECT coalesce(provider, 'ALL') AS provider, count(*) AS calls, round(sum(cost), 6) AS cost, sum(cost) < 100 AS within_budget FROM k GROUP BY ROLLUP (provider)""",
)
def cost_by_provider(spark, sf_dir):
    e, m = table(spark, sf_dir, "events"), F.col("event_id") % 3
    calls = e.select(F.when(m == 0, "openai").when(m == 1, "google").otherwise("none").alias("provider"), F.when(m == 0, "gpt-4o").when(m == 1, "gemini-1.5-flash").otherwise("none").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 500).alias("output_tokens"))
    return evaluate.cost_summary(evaluate.call_cost(calls)).withColumn("cost", rounded("cost", 6))


@query("cost_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS provider, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2")
def cost_windows(spark, sf_dir):
    from quillspan.streaming.documents import cost_windows as run

    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("provider"), F.col("value").alias("cost"))
    return run(e).withColumn("cost", rounded("cost", 4))


_BUDGET = 3000


@query(
    "running_budget",
    f"""WITH c AS (SELECT event_type AS provider, event_id AS call_id, ts, coalesce(value, 0) AS cost FROM events), t AS (SELECT *, sum(cost) OVER (PARTITION BY provider ORDER BY ts, call_id) AS total FROM c)
SELECT provider, call_id, ts, cost, round(total, 4) AS total, round(total, 4) < {_BUDGET} AS within_budget, round(total, 4) >= {_BUDGET} AND round(total - cost, 4) < {_BUDGET} AS passes FROM t""",
)
def running_budget(spark, sf_dir):
    """The events as a stream in three steps with a restart: each call with its provider's cost so far."""
    from quillspan.streaming.budget import replay

    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("provider"), F.col("event_id").alias("call_id"), "ts", F.col("value").alias("cost"))
    got = replay(calls, _BUDGET, interval=6 * 3600)
    return got.select("provider", "call_id", F.col("ts").cast(e.schema["ts"].dataType).alias("ts"), "cost", rounded("total", 4).alias("total"), "within_budget", "passes")


@query(
    "extractor_stats",
    "SELECT event_type AS extractor, count(*) AS n, round(sum(value), 4) AS total_s, round(avg(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s, CAST(sum(event_id) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens, round(sum(value), 4) AS cost FROM events GROUP BY 1",
)
def extractor_stats(spark, sf_dir):
    from quillspan.operators.entities import extractor_statistics

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("extractor"), F.col("value").alias("seconds"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.col("value").alias("cost"))
    return extractor_statistics(e).withColumns({"total_s": rounded("total_s", 4), "mean_s": rounded("mean_s", 6), "cost": rounded("cost", 4)})


@query(
    "paired_tests",
    """WITH d AS (SELECT l_extendedprice - l_quantity * 1500 AS d FROM lineitem), t AS (SELECT count(d) AS n, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM d),
s AS (SELECT abs(d) AS x, d FROM d WHERE d <> 0), z AS (SELECT x, count(*) AS c, count(*) FILTER (d > 0) AS plus FROM s GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY x) - (c - 1) / 2 AS rank FROM z)
SELECT (SELECT n FROM t) AS n, round((SELECT t FROM t), 6) AS t, round(sum(rank * plus), 1) AS w_plus, round(sum(rank * (c - plus)), 1) AS w_minus FROM r""",
)
def paired_tests(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("other"))
    t, w = evaluate.paired_t(df, "l_extendedprice", "other"), evaluate.wilcoxon(df, "l_extendedprice", "other")
    return t.select("n", rounded("t", 6).alias("t")).join(F.broadcast(w.select(rounded("w_plus", 1).alias("w_plus"), rounded("w_minus", 1).alias("w_minus"))))


def _counted_sql(name, key):
    """``name`` (doc_id, type, tp, fp, fn) of distinct keys."""
    return f"""{name}0 AS (SELECT coalesce(p.doc_id, g.doc_id) AS doc_id, coalesce(p.type, g.type) AS type, p.key AS pk, g.key AS gk FROM (SELECT DISTINCT doc_id, type, {key} AS key FROM pred) p FULL JOIN (SELECT DISTINCT doc_id, type, {key} AS key FROM gold) g ON p.doc_id = g.doc_id AND p.type = g.type AND p.key = g.key),
{name} AS (SELECT doc_id, type, count(*) FILTER (pk IS NOT NULL AND gk IS NOT NULL) AS tp, count(*) FILTER (gk IS NULL) AS fp, count(*) FILTER (pk IS NULL) AS fn FROM {name}0 GROUP BY 1, 2)"""


_REPLICAS = 200
_Z = "CAST(({} * 1000003 + r) AS UHUGEINT) * 11400714819323198485 % 18446744073709551616"


def _mixed(z, shift, factor):
    """One step of the mixing in 64 bits."""
    return f"CAST(CAST(xor({z}, {z} >> {shift}) AS UHUGEINT) * {factor} % 18446744073709551616 AS UBIGINT)"


@query(
    "bootstrap_f1",
    f"""{BASE}, {_counted_sql("x", KEY)}, {_counted_sql("y", "length(value)")},
b AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.type, y.type) AS type, coalesce(x.tp, 0) AS t0, coalesce(x.fp, 0) AS p0, coalesce(x.fn, 0) AS n0, coalesce(y.tp, 0) AS t1, coalesce(y.fp, 0) AS p1, coalesce(y.fn, 0) AS n1 FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.type = y.type),
z0 AS (SELECT *, CAST({_Z.format("doc_id")} AS UBIGINT) AS z FROM b, range({_REPLICAS}) t(r)), z1 AS (SELECT * EXCLUDE (z), {_mixed("z", 30, 13787848793156543929)} AS z FROM z0), z2 AS (SELECT * EXCLUDE (z), {_mixed("z", 27, 10723151780598845931)} AS z FROM z1),
z3 AS (SELECT * EXCLUDE (z), CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM z2), wt AS (SELECT *, {" + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in evaluate.POISSON)} AS w FROM z3),
f AS (SELECT type, r, CASE WHEN sum(w * t0) > 0 THEN 2 * sum(w * t0) / sum(w * (2 * t0 + p0 + n0)) ELSE 0 END - CASE WHEN sum(w * t1) > 0 THEN 2 * sum(w * t1) / sum(w * (2 * t1 + p1 + n1)) ELSE 0 END AS d FROM wt GROUP BY 1, 2),
l AS (SELECT type, list_sort(list(d)) AS d FROM f GROUP BY 1), o AS (SELECT type, count(*) AS documents, CASE WHEN sum(t0) > 0 THEN 2 * sum(t0) / sum(2 * t0 + p0 + n0) ELSE 0 END AS a, CASE WHEN sum(t1) > 0 THEN 2 * sum(t1) / sum(2 * t1 + p1 + n1) ELSE 0 END AS b FROM b GROUP BY 1)
SELECT type, documents, round(a, 6) AS f1_first, round(b, 6) AS f1_second, round(a - b, 6) AS difference, round(d[5], 6) AS low, round(d[{_REPLICAS} - 4], 6) AS high,
  round(least(1, 2 * least(len(list_filter(d, lambda v: v <= 0)) + 1, len(list_filter(d, lambda v: v >= 0)) + 1) / {_REPLICAS + 1}), 6) AS p FROM o JOIN l USING (type)""",
)
def bootstrap_f1(spark, sf_dir):
    """Intervals for the difference in F1 of exact values and of values that only agree in length."""
    pred, gold = pred_gold(spark, sf_dir)
    lengths = [df.withColumn("key", F.char_length("value")) for df in (pred, gold)]
    exact = [df.withColumn("key", T.spaced(F.col("value"))) for df in (pred, gold)]
    counts = [evaluate.set_counts(*side, ["doc_id", "type", "key"], ["doc_id", "type"]) for side in (exact, lengths)]
    got = evaluate.bootstrap_f1(*counts, by=["type"], replicas=_REPLICAS)
    return got.select("type", "documents", *[rounded(c, 6).alias(c) for c in ("f1_first", "f1_second", "difference", "low", "high", "p")])


@query(
    "signed_rank_exact",
    """WITH d AS (SELECT n_nationkey AS k, round(avg(c_acctbal), 2) - round(avg(s_acctbal), 2) AS d FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
x AS (SELECT round(abs(d), 6) AS x, d > 0 AS plus FROM d WHERE d <> 0), r AS (SELECT plus, CAST(2 * avg(i) OVER (PARTITION BY x) AS INT) AS r FROM (SELECT *, row_number() OVER (ORDER BY x) AS i FROM x)),
w AS (SELECT count(*) AS n, sum(CASE WHEN plus THEN r ELSE 0 END) / 2 AS w_plus, sum(CASE WHEN plus THEN 0 ELSE r END) / 2 AS w_minus, list(r) AS rs FROM r),
p AS (SELECT *, list_reduce(list_prepend([CAST(1 AS DOUBLE)], list_transform(rs, lambda v: [CAST(v AS DOUBLE)])), lambda a, v: list_transform(range(1, len(a) + CAST(v[1] AS INT) + 1), lambda k: coalesce(a[k], 0) + CASE WHEN k > v[1] THEN coalesce(a[CAST(k - v[1] AS INT)], 0) ELSE 0 END)) AS ways FROM w)
SELECT n, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus, round(least(1, 2 * list_sum(ways[1 : CAST(2 * least(w_plus, w_minus) AS INT) + 1]) / pow(2, n)), 9) AS p FROM p""",
)
def signed_rank_exact(spark, sf_dir):
    """Customers' against suppliers' mean balances, paired by nation: few pairs, so the exact distribution."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    a = customer.groupBy(F.col("c_nationkey").alias("k")).agg(rounded(F.avg("c_acctbal"), 2).alias("a"))
    b = supplier.groupBy(F.col("s_nationkey").alias("k")).agg(rounded(F.avg("s_acctbal"), 2).alias("b"))
    both = nation.select(F.col("n_nationkey").alias("k")).join(a, "k").join(b, "k").select(rounded(F.col("a") - F.col("b"), 6).alias("d"), F.lit(0.0).alias("zero"))
    return evaluate.wilcoxon(both, "d", "zero").select("n", rounded("w_plus", 1).alias("w_plus"), rounded("w_minus", 1).alias("w_minus"), rounded("p", 9).alias("p"))


@query(
    "rank_models",
    """WITH m AS (SELECT s_name AS model, s_suppkey AS seq, round(s_acctbal / 10000, 4) AS f1, s_nationkey % 2 AS d FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY f1 DESC, seq) AS rank FROM m) SELECT model, f1, rank FROM r""",
)
def rank_models(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("model"), F.col("s_suppkey").alias("seq"), rounded(F.col("s_acctbal") / 10000, 4).alias("f1"))
    return evaluate.rank_models(df).select("model", "f1", F.col("rank").cast("long").alias("rank"))


@query("compare_datasets", "SELECT n_name AS model, round(a.f - b.f, 4) AS difference FROM nation JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS f FROM supplier GROUP BY 1) a ON n_nationkey = a.k JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS f FROM customer GROUP BY 1) b ON n_nationkey = b.k")
def compare_datasets(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    sides = [table(spark, sf_dir, t).join(n, F.col(f"{p}_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("model")).agg(F.avg(f"{p}_acctbal").alias("f1")) for t, p in (("supplier", "s"), ("customer", "c"))]
    return evaluate.compare_datasets(*sides).select("model", rounded("difference", 4).alias("difference"))


@query("top_types", "SELECT p_type AS type, max(p_size) AS f1, count(*) AS support FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_types(spark, sf_dir):
    return evaluate.top_types(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("type")).agg(F.max("p_size").alias("f1"), F.count("*").alias("support")))


@query(
    "consolidated_results",
    "SELECT 'customers' AS dataset, c_mktsegment AS model, count(*) AS n, NULL AS total FROM customer GROUP BY 2 UNION ALL SELECT 'orders', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2",
)
def consolidated_results(spark, sf_dir):
    from quillspan.sources.sinks import consolidated

    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"), rounded(F.sum("o_totalprice"), 2).alias("total"))
    return consolidated({"customers": a, "orders": b})


_TOK = r"""t0 AS (SELECT conv_id * 100 + turn AS k, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
t1 AS (SELECT k, unnest(w) AS w, unnest(range(len(w))) AS pos FROM t0)"""


def _tokens(spark, sf_dir):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.posexplode(w).alias("pos", "w"))


@query(
    "bio_encode",
    f"""WITH {_TOK}, e AS (SELECT k, pos AS seq, CASE WHEN pos % 20 = 0 THEN 'A' ELSE 'B' END AS type, pos * 10 AS s, pos * 10 + 25 AS e FROM t1 WHERE pos % 10 = 0),
h AS (SELECT t1.k, pos, seq, (CASE WHEN row_number() OVER (PARTITION BY t1.k, seq ORDER BY pos) = 1 THEN 'B-' ELSE 'I-' END) || type AS l FROM t1 JOIN e ON t1.k = e.k AND pos * 10 >= s AND pos * 10 + 5 <= e.e),
m AS (SELECT k, pos, arg_max(l, seq) AS l FROM h GROUP BY 1, 2) SELECT t1.k, CAST(t1.pos AS INT) AS pos, coalesce(m.l, 'O') AS label FROM t1 LEFT JOIN m ON t1.k = m.k AND t1.pos = m.pos""",
)
def bio_encode(spark, sf_dir):
    t = _tokens(spark, sf_dir).select("k", "pos", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + 5).alias("end"))
    e = t.where("pos % 10 = 0").select("k", F.col("pos").alias("seq"), F.when(F.col("pos") % 20 == 0, "A").otherwise("B").alias("type"), "start", (F.col("start") + 25).alias("end"))
    return bio.encode(t, e, "k").select("k", "pos", "label")


_LAB = f"""WITH {_TOK}, l AS (SELECT k, pos, CASE length(w) % 5 WHEN 0 THEN 'B-A' WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-B' WHEN 3 THEN 'B-B' ELSE 'O' END AS label, (1 + length(w) % 7) / 10 AS c FROM t1)"""


def _labelled(spark, sf_dir):
    lab = F.element_at(F.array(*[F.lit(x) for x in ("B-A", "I-A", "I-B", "B-B", "O")]), (F.char_length("w") % 5 + 1).cast("int"))
    return _tokens(spark, sf_dir).select("k", "pos", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + 5).alias("end"), lab.alias("label"), ((1 + F.char_length("w") % 7) / 10).alias("confidence"))


@query(
    "bio_decode",
    f"""{_LAB}, b AS (SELECT *, lag(label) OVER (PARTITION BY k ORDER BY pos) AS p FROM l),
s AS (SELECT *, CASE WHEN label = 'O' OR label LIKE 'B%' OR p IS NULL OR p = 'O' OR right(p, 1) <> right(label, 1) THEN 1 ELSE 0 END AS n FROM b),
g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY pos) AS g FROM s) SELECT k, right(min(label), 1) AS type, CAST(min(pos) * 10 AS INT) AS start, CAST(max(pos) * 10 + 5 AS INT) AS "end", min(c) AS confidence FROM g WHERE label <> 'O' GROUP BY k, g""",
)
def bio_decode(spark, sf_dir):
    return bio.decode(_labelled(spark, sf_dir), "k").select("k", F.explode("spans").alias("s")).select("k", "s.type", "s.start", "s.end", "s.confidence")


@query(
    "bio_decode_skip",
    f"""{_LAB}, a AS (SELECT *, sum(CAST(label = 'O' OR label LIKE 'B%' AS INT)) OVER (PARTITION BY k ORDER BY pos) AS g FROM l), h AS (SELECT *, first_value(label) OVER (PARTITION BY k, g ORDER BY pos) AS f FROM a)
SELECT k, right(min(f), 1) AS type, CAST(min(pos) * 10 AS INT) AS start, CAST(max(pos) * 10 + 5 AS INT) AS "end" FROM h WHERE f LIKE 'B%' AND right(label, 1) = right(f, 1) GROUP BY k, g""",
)
def bio_decode_skip(spark, sf_dir):
    return bio.decode(_labelled(spark, sf_dir), "k", "skip").select("k", F.explode("spans").alias("s")).select("k", "s.type", "s.start", "s.end")


@query(
    "bio_decode_close",
    f"""{_LAB}, a AS (SELECT *, sum(CAST(label = 'O' OR label LIKE 'B%' AS INT)) OVER (PARTITION BY k ORDER BY pos) AS g FROM l), h AS (SELECT *, first_value(label) OVER (PARTITION BY k, g ORDER BY pos) AS f FROM a),
z AS (SELECT *, sum(CAST(right(label, 1) <> right(f, 1) AS INT)) OVER (PARTITION BY k, g ORDER BY pos) AS closed FROM h)
SELECT k, right(min(f), 1) AS type, CAST(min(pos) * 10 AS INT) AS start, CAST(max(pos) * 10 + 5 AS INT) AS "end" FROM z WHERE f LIKE 'B%' AND closed = 0 GROUP BY k, g""",
)
def bio_decode_close(spark, sf_dir):
    return bio.decode(_labelled(spark, sf_dir), "k", "close").select("k", F.explode("spans").alias("s")).select("k", "s.type", "s.start", "s.end")


@query(
    "class_weights",
    r"""WITH n AS (SELECT 'O' AS label, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS n FROM documents UNION ALL
SELECT unnest(['B-', 'I-']) || event_type, unnest([count(*), sum(greatest(len(list_filter(regexp_split_to_array(props, '\s+'), lambda x: x <> '')) - 1, 1))]) FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type),
l AS (SELECT unnest(['O', 'B-click', 'I-click', 'B-view', 'I-view', 'B-purchase', 'I-purchase']) AS label), c AS (SELECT l.label, coalesce(n, 0) AS n FROM l LEFT JOIN n USING (label)),
w AS (SELECT label, (SELECT sum(n) FROM c) / (7 * n + 1) AS w FROM c) SELECT label, round(least(greatest(w / (SELECT avg(w) FROM w), 0.1), 10.0), 6) AS weight FROM w""",
)
def class_weights(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("props").alias("value"))
    return bio.class_weights(e, table(spark, sf_dir, "documents"), ["click", "view", "purchase"]).select("label", rounded("weight", 6).alias("weight"))


_ISLANDS = """SELECT *, lag({0}) OVER (PARTITION BY k ORDER BY pos) AS p FROM l"""


def _spans_sql(label):
    return f"""SELECT DISTINCT k, right(min({label}), 1) AS type, min(pos) AS s, max(pos) AS e FROM (
  SELECT *, sum(CASE WHEN {label} = 'O' OR {label} LIKE 'B%' OR p IS NULL OR p = 'O' OR right(p, 1) <> right({label}, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS g FROM ({_ISLANDS.format(label)}))
  WHERE {label} <> 'O' GROUP BY k, g"""


@query(
    "entity_level_scores",
    f"""{_LAB.rpartition("l AS")[0]} l0 AS {_LAB.rpartition("l AS")[2]}, l AS (SELECT *, CASE WHEN pos % 11 = 4 THEN 'O' WHEN pos % 13 = 6 THEN 'I-B' ELSE label END AS guess FROM l0), g AS ({_spans_sql("label")}), p AS ({_spans_sql("guess")}),
c AS (SELECT coalesce(p.type, g.type) AS type, count(*) FILTER (p.e IS NOT NULL AND g.e IS NOT NULL) AS tp, count(*) FILTER (g.e IS NULL) AS fp, count(*) FILTER (p.e IS NULL) AS fn FROM p FULL JOIN g ON p.k = g.k AND p.type = g.type AND p.s = g.s AND p.e = g.e GROUP BY 1) SELECT type, {PRF} FROM c""",
)
def entity_level_scores(spark, sf_dir):
    guess = F.when(F.col("pos") % 11 == 4, "O").when(F.col("pos") % 13 == 6, "I-B").otherwise(F.col("label"))
    return scores(bio.entity_scores(_labelled(spark, sf_dir).withColumn("guess", guess), "k", "label", "guess", ["type"]), "type")


_ORDER = "r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)"


@query("split_folds", f"WITH {_ORDER} SELECT doc_id, CASE WHEN r <= floor(n * 0.15) THEN 'validation' ELSE 'train' END AS split, CAST(least((r - 1) // greatest(n // 5, 1), 4) AS INT) AS fold FROM r")
def split_folds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return bio.folds(bio.train_validation(d, "doc_id"), "doc_id")


@query("type_histogram", "SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def type_histogram(spark, sf_dir):
    return bio.histogram(table(spark, sf_dir, "part").select(F.col("p_type").alias("type")))


@query(
    "metrics_facade",
    f"""{BASE}, p AS (SELECT DISTINCT doc_id, type, {KEY} AS key FROM pred), g AS (SELECT DISTINCT doc_id, type, {KEY} AS key FROM gold),
c AS (SELECT count(*) FILTER (p.key IS NOT NULL AND g.key IS NOT NULL) AS tp, count(*) FILTER (g.key IS NULL) AS fp, count(*) FILTER (p.key IS NULL) AS fn FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.type = g.type AND p.key = g.key),
b AS (SELECT p.doc_id, p.type, p.seq, max({JACCARD}) AS s FROM pred p JOIN gold g ON p.doc_id = g.doc_id AND p.type = g.type GROUP BY ALL),
q AS (SELECT coalesce(sum(s) FILTER (s >= 0.5), 0) / (SELECT count(*) FROM pred) AS pp, coalesce(sum(s) FILTER (s >= 0.5), 0) / (SELECT count(*) FROM gold) AS pr FROM b),
gt AS (SELECT DISTINCT doc_id, type FROM gold), h AS (SELECT gt.doc_id, avg(CAST(x.type IS NOT NULL AS INT)) AS c FROM gt LEFT JOIN (SELECT DISTINCT doc_id, type FROM pred) x ON gt.doc_id = x.doc_id AND gt.type = x.type GROUP BY 1),
docs AS (SELECT doc_id FROM pred UNION SELECT doc_id FROM gold), cv AS (SELECT avg(coalesce(h.c, 1)) AS c FROM docs LEFT JOIN h USING (doc_id)),
t AS (SELECT doc_id, type, count(*) AS n, count(DISTINCT {KEY}) AS d FROM pred GROUP BY 1, 2), k AS (SELECT doc_id, coalesce(avg(1 / d) FILTER (n > 1), 1) AS k FROM t GROUP BY 1)
SELECT 'exact_precision' AS metric, round(tp / (tp + fp), 6) AS value FROM c UNION ALL SELECT 'exact_recall', round(tp / (tp + fn), 6) FROM c UNION ALL SELECT 'exact_f1', round(2 * tp / (2 * tp + fp + fn), 6) FROM c
UNION ALL SELECT 'partial_precision', round(pp, 6) FROM q UNION ALL SELECT 'partial_recall', round(pr, 6) FROM q UNION ALL SELECT 'partial_f1', round(2 * pp * pr / (pp + pr), 6) FROM q
UNION ALL SELECT 'coverage', round(c, 6) FROM cv UNION ALL SELECT 'consistency', round(avg(k), 6) FROM k""",
)
def metrics_facade(spark, sf_dir):
    return evaluate.compute_metrics(*pred_gold(spark, sf_dir)).withColumn("value", rounded("value", 6))


@query("jaccard_empty", f"""{BASE} SELECT p.doc_id, p.type, p.seq, round(CASE WHEN len({PW}) = 0 AND len({GW}) = 0 THEN 1 ELSE {JACCARD} END, 6) AS score FROM (SELECT * REPLACE (CASE WHEN seq % 5 = 0 THEN ' ' ELSE value END AS value) FROM pred) p JOIN (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN '' ELSE value END AS value) FROM gold) g ON p.doc_id = g.doc_id AND p.seq = g.seq""")
def jaccard_empty(spark, sf_dir):
    pred, gold = pred_gold(spark, sf_dir)
    both = pred.join(gold.select("doc_id", "seq", F.col("value").alias("gold")), ["doc_id", "seq"])
    v, g = F.when(F.col("seq") % 5 == 0, " ").otherwise(F.col("value")), F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("gold"))
    return both.select("doc_id", "type", "seq", rounded(S.jaccard(v, g, 1.0), 6).alias("score"))


@query(
    "model_ranking",
    f"""{BASE}, m AS (SELECT 'whole' AS model, * FROM pred UNION ALL SELECT 'half', * FROM pred WHERE seq % 2 = 0 UNION ALL SELECT 'marked', * REPLACE (CASE WHEN seq % 5 = 0 THEN value || '#' ELSE value END AS value) FROM pred),
n AS (SELECT unnest(['none', 'whole', 'half', 'marked']) AS model, unnest(range(4)) AS i), x AS (SELECT DISTINCT n.model, doc_id, type, {KEY} AS key FROM gold CROSS JOIN n WHERE NOT (n.model = 'half' AND doc_id % 4 = 1)),
p AS (SELECT DISTINCT model, doc_id, type, {KEY} AS key FROM m WHERE NOT (model = 'half' AND doc_id % 4 = 1)),
c AS (SELECT coalesce(p.model, x.model) AS model, count(*) FILTER (p.key IS NOT NULL AND x.key IS NOT NULL) AS tp, count(*) FILTER (x.key IS NULL) AS fp, count(*) FILTER (p.key IS NULL) AS fn FROM p FULL JOIN x ON p.model = x.model AND p.doc_id = x.doc_id AND p.type = x.type AND p.key = x.key GROUP BY 1)
SELECT model, {PRF}, row_number() OVER (ORDER BY CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END DESC, i) AS rank FROM c JOIN n USING (model)""",
)
def model_ranking(spark, sf_dir):
    from quillspan.operators.pipelines import run_models

    pred, gold = pred_gold(spark, sf_dir)
    marked = pred.withColumn("value", F.when(F.col("seq") % 5 == 0, F.concat("value", F.lit("#"))).otherwise(F.col("value")))
    runs = run_models({"whole": pred, "half": pred.where("seq % 2 = 0"), "marked": marked})
    failed = pred.where("doc_id % 4 = 1").select(F.lit("half").alias("model"), "doc_id")
    got = evaluate.evaluate_models(runs, gold, ["none", "whole", "half", "marked"], failed=failed)
    return scores(got.withColumn("rank", F.col("rank").cast("long")), "model", "rank")
