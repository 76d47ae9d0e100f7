"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import audit, bpe, chat, decontam, embed, periodic, quality, rules, shards, simhash, substring, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of op10; QUILLSPAN_TOKENIZER names another."""
    if path := os.environ.get("QUILLSPAN_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    talk = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    events = talk.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message"), F.lit("message").alias("kind"), "role", "text")
    made = chat.render(chat.fold(events))
    back = chat.read_back(made)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"))
    length = made.select(F.col("conv_id").alias("c"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return back.join(length, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select(F.col("row.doc_id").alias("doc_id"), "item_id", "found", "size")


def op6_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = embed.near_vectors(_table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), "quality")
    got = quality.score(docs, model)
    return got.select(F.col("row.doc_id").alias("doc_id"), quality.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    got = toxicity.score(docs, model)
    return got.select(F.col("row.doc_id").alias("doc_id"), "severity", "grade", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    _, back = shards.shard_table(docs, arrivals=4)
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten texts, by crc32 of the id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", audit.BLANKS), lambda w: w != ""))
    base = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    base = base.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    base = base.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("words"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return base.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.collapse_runs(with_periodic_tails(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    got = got.select(F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return got.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = rules.fit(docs, _table(spark, sf_dir, "labels"))
    got = rules.judge(docs, learned)
    return got.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = audit.text_masks(_table(spark, sf_dir, "documents"))
    counts = audit.mask_counts(masks, _table(spark, sf_dir, "labels"), marked={"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return audit.audit(counts, "ABCDE", ("good", "toxic"))


QUERIES = {f.__name__: f for f in (op1_chat, op2_simhash, op3_warc, op4_substring, op5_decontam, op6_embed, op7_quality, op8_toxicity, op9_shards, op10_bpe, op11_periodic, op12_rules, op13_audit)}

#: What DuckDB's regular expressions take for a control string of the chat template.
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?RESP\]|/?SYS\]|/?ROLE\])"

ORACLES = {
    "op1_chat": rf"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
t AS (
  SELECT *, regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g') AS body,
    CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 7 WHEN 'system' THEN 6
      ELSE 16 + length(regexp_replace(role, '{_CONTROL}', '\1\2\\\3', 'g')) END AS head
  FROM talk),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(3 + head + length(body) + 4) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100""",
    "op4_substring": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS m FROM s),
r AS (SELECT doc_id, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
k AS (SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.k) FILTER (c.k IS NULL) AS kept, count(c.k) AS gone FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.k = c.k GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op5_decontam": r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t),
i AS (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s FROM i),
n AS (SELECT id, count(*) AS size FROM s WHERE kind = 1 GROUP BY 1),
f AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS found FROM s a JOIN s b ON a.kind = 0 AND b.kind = 1 AND a.s = b.s GROUP BY 1, 2)
SELECT f.doc_id, f.item_id, f.found, n.size FROM f JOIN n ON f.item_id = n.id WHERE f.found >= 0.8 * n.size""",
    "op6_embed": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT m.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN k ON m.vec_id = k.a""",
    "op9_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op11_periodic": r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (
  SELECT doc_id, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab),
w AS (SELECT doc_id, h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM h),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_select(w, list_transform(range(n), lambda i: CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END)) END AS w FROM p),
l AS (SELECT doc_id, n, unnest(range(n)) AS k, unnest(w) AS x FROM d),
g AS (SELECT doc_id, n, k AS i, concat_ws(' ', x, lead(x, 1) OVER v, lead(x, 2) OVER v, lead(x, 3) OVER v, lead(x, 4) OVER v) AS x FROM l WINDOW v AS (PARTITION BY doc_id ORDER BY k)),
q AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND b.i <= a.n - 5 AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
e AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + q + 5 AS length FROM s GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM e WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
m AS (
  SELECT doc_id, count(*) AS n_runs, max(struct_pack(length := length, start := -start, period := -period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM r GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS k FROM r),
k AS (SELECT l.doc_id, string_agg(l.x, ' ' ORDER BY l.k) FILTER (c.k IS NULL) AS kept FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.k = c.k GROUP BY 1)
SELECT d.doc_id, coalesce(m.n_runs, 0) AS n_runs, -m.best.start AS start, m.best.length AS length, -m.best.period AS period,
  1000 * m.best.length // -m.best.period AS exponent_milli, sha256(coalesce(m.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op13_audit": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
      CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
o AS (SELECT '' AS o UNION ALL SELECT o || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k : k] AS x FROM o, (SELECT unnest(range(1, 6)) AS k) WHERE length(o) = 5),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
a AS (
  SELECT part, filter_order, step, x, n, good, toxic, contains(fails, x) AS fails_x, fails = x AS only_x,
    coalesce(list_min(list_transform(string_split(fails, ''), lambda y: CASE WHEN y = '' THEN 9 ELSE position(y IN filter_order) END)), 9) AS gone
  FROM c, s),
r AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails_x AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM a GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM r""",
}
