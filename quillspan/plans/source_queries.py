"""Queries over files, reports, runs of strategies and vocabularies: what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.numbers import rounded
from quillspan.functions import validate as V
from quillspan.operators import bio, parse, pipelines, prompts, providers, retrieval
from quillspan.operators.calls import CallTable
from quillspan.operators.text_index import TextIndex
from quillspan.plans.entity_queries import _ASKED, _QA, _RE, _VARIED, _WHOLE, _hedged_sql, _qa, _talk
from quillspan.plans.entity_queries import _BM as BM25
from quillspan.plans.match_queries import _TOK, _tokens
from quillspan.plans.registry import query
from quillspan.plans.text_queries import table
from quillspan.sources import annotations, sinks
from quillspan.sources.shared import fresh_folder

_ORDERS = "SELECT o_orderpriority AS model, o_orderstatus AS type, round(avg(o_totalprice) / 1e6, 6) AS precision, round(count(*) / 1e4, 6) AS recall, count(*) AS n FROM orders GROUP BY 1, 2"


def _scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    got = o.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("type")).agg(rounded(F.avg("o_totalprice") / 1e6, 6).alias("precision"), rounded(F.count("*") / 1e4, 6).alias("recall"), F.count("*").alias("n"))
    return got


@query("results_csv", f"WITH s AS ({_ORDERS}) SELECT type, model, printf('%.4f', precision) AS precision, printf('%.4f', recall) AS recall, CAST(n AS VARCHAR) AS n FROM s")
def results_csv(spark, sf_dir):
    """Scores as CSV with a folder for each type, read again as text."""
    path = fresh_folder(spark, "csv")
    sinks.write_csv(_scores(spark, sf_dir), path, by=["type"])
    return spark.read.option("header", True).schema("model string, precision string, recall string, n string, type string").csv(path).select("type", "model", "precision", "recall", "n")


@query("results_json", _ORDERS)
def results_json(spark, sf_dir):
    scores, path = _scores(spark, sf_dir), fresh_folder(spark, "json")
    sinks.write_json(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query(
    "nested_results",
    f"""WITH s AS ({_ORDERS}), o AS (SELECT model, sum(n) AS n FROM s GROUP BY 1)
SELECT model, o.n AS overall, s.type, s.precision, s.n AS type_n FROM o JOIN s USING (model)""",
)
def nested_results(spark, sf_dir):
    """One JSON object a model, its overall counts and a map of those by type, taken apart again."""
    s = _scores(spark, sf_dir)
    made = sinks.nested_results(s.groupBy("model").agg(F.sum("n").alias("n")), s.select("model", "type", "precision", "n"))
    x = F.from_json("json", "struct<overall: struct<n: long>, per_type: map<string, struct<precision: double, n: long>>>")
    got = made.select("model", x.alias("x")).select("model", F.col("x.overall.n").alias("overall"), F.explode("x.per_type").alias("type", "s"))
    return got.select("model", "overall", "type", "s.precision", F.col("s.n").alias("type_n"))


@query("call_log", "SELECT event_type AS provider, event_id AS call, event_id % 2 = 0 AS even FROM events")
def call_log(spark, sf_dir):
    """The log of calls, appended to in two steps."""
    path, e = fresh_folder(spark, "log"), table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("event_id").alias("call"), (F.col("event_id") % 2 == 0).alias("even"))
    for half in (True, False):
        sinks.append_calls(e.where(F.col("even") == half), path)
    return spark.read.schema(e.schema).json(path)


_RANKED = "SELECT o_orderpriority AS model, round(avg(o_totalprice) / 1e6, 6) AS f1, count(*) AS n, row_number() OVER (ORDER BY avg(o_totalprice) DESC) AS rank FROM orders GROUP BY 1"


def _ranked(spark, sf_dir):
    from quillspan.operators.evaluate import rank_models

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(rounded(F.avg("o_totalprice") / 1e6, 6).alias("f1"), F.count("*").alias("n"))
    return rank_models(o.withColumn("seq", F.lit(0))).select("model", "f1", "n", "rank")


@query(
    "report_markdown",
    f"""WITH r AS ({_RANKED}) SELECT '# Models' || chr(10) || chr(10) || 'Best: ' || first(model ORDER BY rank) || chr(10) || chr(10) || '| model | f1 | n | rank |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
|| string_agg('| ' || model || ' | ' || printf('%.4f', f1) || ' | ' || n || ' | ' || rank || ' |', chr(10) ORDER BY rank) || chr(10) AS report FROM r""",
)
def report_markdown(spark, sf_dir):
    return spark.createDataFrame([(sinks.markdown(_ranked(spark, sf_dir), "Models"),)], "report string")


@query(
    "report_latex",
    rf"""WITH r AS ({_RANKED}) SELECT '\begin{{tabular}}{{llll}}' || chr(10) || '\hline' || chr(10) || 'model & f1 & n & rank \\' || chr(10) || '\hline' || chr(10)
|| string_agg(model || ' & ' || printf('%.4f', f1) || ' & ' || n || ' & ' || rank || ' \\', chr(10) ORDER BY rank) || chr(10) || '\hline' || chr(10) || '\end{{tabular}}' AS report FROM r""",
)
def report_latex(spark, sf_dir):
    return spark.createDataFrame([(sinks.latex(_ranked(spark, sf_dir).orderBy("rank")),)], "report string")


@query("chart_data", f"WITH s AS ({_ORDERS}) SELECT model, type, 'precision' AS metric, precision AS value FROM s UNION ALL SELECT model, type, 'recall', recall FROM s")
def chart_data(spark, sf_dir):
    return sinks.chart_data(_scores(spark, sf_dir), ("precision", "recall"))


@query(
    "qa_files",
    f"""WITH {_QA} SELECT title, 0 AS para, CASE q WHEN 'Governing Law' THEN 'GOVERNING_LAW' WHEN 'Non-Compete' THEN 'NON_COMPETE' WHEN 'Parties' THEN 'PARTIES' ELSE 'UNKNOWN_THING' END AS type, v AS value, CAST(k % 100 AS INT) AS start FROM o""",
)
def qa_files(spark, sf_dir):
    """Question-answer files written from a table, found by the names a split may have and read again."""
    folder = fresh_folder(spark, "qa")
    p = _qa(spark, sf_dir)
    data = p.select(F.array(F.struct("title", F.array(F.struct(F.col("text").alias("context"), "qas")).alias("paragraphs"))).alias("data"))
    data.write.json(f"{folder}/cuad_test.json", lineSep="\n")
    raw = spark.read.schema(data.schema).json(annotations.split_path(spark, folder, "test"))
    got = annotations.answers(annotations.paragraphs(raw), annotations.quoted_clause)
    return got.select("title", F.col("para").cast("int").alias("para"), "type", "value", "start")


@query(
    "retriever_bm25",
    f"WITH {BM25}, r AS (SELECT doc_id, chunk_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS rank FROM bm) SELECT doc_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 5",
)
def retriever_bm25(spark, sf_dir):
    """A retriever by name."""
    got = retrieval.retriever("bm25")(*_talk(spark, sf_dir), "doc_id")
    return got.select("doc_id", "chunk_id", rounded("score", 6).alias("score"))


@query(
    "index_search",
    f"WITH {BM25}, r AS (SELECT doc_id, chunk_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) SELECT doc_id, chunk_id, round(score, 6) AS score FROM r WHERE rank <= 3",
)
def index_search(spark, sf_dir):
    """The same conversations' best turns from an index that is built once and read from its files."""
    chunks, queries = _talk(spark, sf_dir)
    got = TextIndex.build(chunks, "doc_id").search(queries, 3)
    return got.select("doc_id", "chunk_id", rounded("score", 6).alias("score"))


_SMALL = 1000  # tokens of a model that few documents fit in


@query(
    "extract_chunk_aggregate",
    f"""WITH w AS (SELECT doc_id, CAST(0 AS INT) AS part, text AS body FROM documents WHERE length(text) // 4 <= 0.9 * {_SMALL}
  UNION ALL SELECT doc_id, CAST(s // 2700 AS INT), substring(text, s + 1, 3000) FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 3000) / 2700.0), 0) AS BIGINT) * 2700 + 1, 2700)) AS s FROM documents WHERE length(text) // 4 > 0.9 * {_SMALL})),
m AS ({" UNION ALL ".join(f"SELECT doc_id, part, '{t}' AS type, unnest(list_distinct(regexp_extract_all(body, '{p}'))) AS value FROM w" for t, p in _RE.items())}) SELECT doc_id, part, type, value FROM m""",
)
def extract_chunk_aggregate(spark, sf_dir):
    """Documents that don't fit in the model's window are asked window by window; one call for each."""
    model, types = providers.create("rules"), list(providers.RULES)
    model.context_window = _SMALL
    got = providers.extract(table(spark, sf_dir, "documents").select("doc_id", "text"), model, lambda t: prompts.zero_shot(t, types), lambda r: parse.model_reply(r, types), "chunk_aggregate", 3000, 300, CallTable(spark))
    return got.select("doc_id", (F.col("seq") / 1_000_000).cast("int").alias("part"), "type", "value")


@query(
    "strategy_runs",
    f"""WITH {_WHOLE}, z AS (SELECT doc_id, 0 AS place, body FROM b), v AS (SELECT doc_id, body, unnest([0, 1, 2]) AS place FROM b),
h AS ({_hedged_sql("z", _ASKED)}), hc AS ({_hedged_sql("v", _VARIED)}), r AS ({" UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, unnest(list_distinct(regexp_extract_all(body, '{p}'))) AS value FROM b" for t, p in _RE.items())})
SELECT 'hedging' AS model, s AS strategy, type, count(*) AS n FROM h, (SELECT unnest(['basic', 'validation']) AS s) GROUP BY ALL UNION ALL SELECT 'rules', s, type, count(*) FROM r, (SELECT unnest(['basic', 'validation']) AS s) GROUP BY ALL
UNION ALL SELECT 'hedging', 'self_consistency', type, count(DISTINCT (doc_id, lower(value))) FROM hc GROUP BY type UNION ALL SELECT 'rules', 'self_consistency', type, count(DISTINCT (doc_id, lower(value))) FROM r GROUP BY type""",
)
def strategy_runs(spark, sf_dir):
    """Every model with every strategy over one call table: what each run finds, by type."""
    docs, models = table(spark, sf_dir, "documents").select("doc_id", "text"), {n: providers.create(n) for n in ("rules", "hedging")}
    runs = pipelines.run_table(list(models), ["basic", "validation", "self_consistency"])
    got = pipelines.run_all(docs, runs, models, list(providers.RULES), most=100_000)
    return got.groupBy("model", "strategy", "type").agg(F.count("*").alias("n"))


@query(
    "validate_profiles",
    r"""WITH v AS (SELECT o_orderkey AS k, ['cpf->socio', 'cnpj->sociedade', 'cep->socio', 'nire->sociedade', 'nome->socio', 'orgao_expedidor_rg'][1 + o_orderkey % 6] AS t,
  CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Ana' WHEN 2 THEN 'Ana ' || o_orderstatus WHEN 3 THEN lpad(CAST(o_custkey AS VARCHAR), 11, '1') WHEN 4 THEN '12.345.678/0001-95' WHEN 5 THEN lpad(CAST(o_custkey AS VARCHAR), 8, '2') ELSE '12.345-6' END AS v FROM orders),
d AS (SELECT *, length(regexp_replace(v, '[^0-9]', '', 'g')) AS n FROM v)
SELECT k, CASE WHEN t LIKE 'cpf%' THEN n = 11 WHEN t LIKE 'cnpj%' THEN n = 14 WHEN t LIKE 'cep%' THEN n = 8 WHEN t LIKE '%rg%' THEN n >= 5 WHEN t LIKE 'nire%' THEN n >= 8 ELSE true END AS script,
  CASE WHEN v = '' THEN false WHEN t LIKE 'cpf%' THEN n = 11 WHEN t LIKE 'cnpj%' THEN n = 14 WHEN t LIKE 'cep%' THEN n = 8 WHEN t LIKE 'nome%' THEN v LIKE '% %' ELSE true END AS strict_names FROM d""",
)
def validate_profiles(spark, sf_dir):
    """The registry's rules by the names of the scripts' types."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (k % len(values) + 1).cast("int"))
    t = pick(["cpf->socio", "cnpj->sociedade", "cep->socio", "nire->sociedade", "nome->socio", "orgao_expedidor_rg"])
    v = pick(["", "Ana", F.concat(F.lit("Ana "), "o_orderstatus"), F.lpad(c, 11, "1"), "12.345.678/0001-95", F.lpad(c, 8, "2"), "12.345-6"])
    return table(spark, sf_dir, "orders").select(k.alias("k"), *[V.registry_entity(t, v, p)["is_valid"].alias(p) for p in ("script", "strict_names")])


@query(
    "bio_encode_strict",
    f"""WITH {_TOK}, e AS (SELECT k, pos AS seq, CASE WHEN pos % 20 = 0 THEN 'A' ELSE 'B' END AS type, pos * 10 - CASE WHEN pos % 30 = 0 THEN 2 ELSE 0 END AS s, pos * 10 + 25 AS e FROM t1 WHERE pos % 10 = 0),
h AS (SELECT t1.k, pos, seq, (CASE WHEN pos * 10 = s THEN 'B-' ELSE 'I-' END) || type AS l FROM t1 JOIN e ON t1.k = e.k AND pos * 10 >= s AND pos * 10 + 5 <= e.e),
m AS (SELECT k, pos, arg_max(l, seq) AS l FROM h GROUP BY 1, 2) SELECT t1.k, CAST(t1.pos AS INT) AS pos, coalesce(m.l, 'O') AS label FROM t1 LEFT JOIN m ON t1.k = m.k AND t1.pos = m.pos""",
)
def bio_encode_strict(spark, sf_dir):
    """B only for tokens that begin where their entity does."""
    t = _tokens(spark, sf_dir).select("k", "pos", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + 5).alias("end"))
    e = t.where("pos % 10 = 0").select("k", F.col("pos").alias("seq"), F.when(F.col("pos") % 20 == 0, "A").otherwise("B").alias("type"), (F.col("start") - F.when(F.col("pos") % 30 == 0, 2).otherwise(0)).alias("start"), (F.col("start") + 25).alias("end"))
    return bio.encode(t, e, "k", strict=True).select("k", "pos", "label")
