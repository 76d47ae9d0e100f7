"""Queries over text: normalisation, validation, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.numbers import rounded
from quillspan.functions import text as T
from quillspan.functions import validate as V
from quillspan.operators import chunking as C
from quillspan.plans.registry import query
from quillspan.sources.shared import small_batches
from quillspan.sources.vocab import SEGMENT_KEYWORDS


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The normal forms in DuckDB's words (the tables hold no white space beyond ASCII).
SPACED = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
SIMPLE = "translate(" + SPACED + ", '.,;:!?\"''()[]{{}}', '')"


@query(
    "text_normalise",
    f"""SELECT doc_id, md5({SIMPLE.format('text')}) AS simple, md5({SPACED.format('text')}) AS spaced,
  md5(regexp_replace({SPACED.format('text')}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g')) AS wordy, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents""",
)
def text_normalise(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(f(t)).alias(n) for n, f in (("simple", T.simple), ("spaced", T.spaced), ("wordy", T.wordy), ("digits", T.only_digits))])


@query(
    "text_clean",
    r"""SELECT c_custkey, 'A b' || chr(10) || chr(10) || 'x - ' || c_name || ' "q"' || chr(10) || 'end ' || c_custkey AS cleaned FROM customer""",
)
def text_clean(spark, sf_dir):
    raw = F.concat(F.lit("  A \t b\n \n\n\nx – "), "c_name", F.lit(" “q”\n  Page "), F.col("c_custkey").cast("string"), F.lit(" OF 99 \n- "), F.col("c_custkey").cast("string"), F.lit(" -\nend "), F.col("c_custkey").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean_document(raw).alias("cleaned"))


@query("clause_types", "SELECT p_partkey, translate(upper(trim(p_type)), ' -/', '___') AS clause, 'IP_OWNERSHIP_ASSIGNMENT' AS alias FROM part")
def clause_types(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clause_type(F.col("p_type")).alias("clause"), T.clause_type(F.lit("Ip Ownership")).alias("alias"))


@query(
    "digits_or_text",
    r"""WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_custkey || '.00-7' ELSE c_name || '  X' END AS v FROM customer)
SELECT c_custkey, CASE WHEN regexp_full_match(regexp_replace(v, '\s', '', 'g'), '[\d.\-/]+') THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE trim(regexp_replace(lower(v), '\s+', ' ', 'g')) END AS form FROM v""",
)
def digits_or_text(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    v = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), key, F.lit(".00-7"))).otherwise(F.concat("c_name", F.lit("  X")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.digits_or_spaced(v).alias("form"))


@query(
    "tokenize",
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda w: length(w) > 2) AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS words FROM t""",
)
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


@query(
    "sentence_split",
    r"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?[.!?]\s+|.+)') AS p FROM documents),
e AS (SELECT doc_id, unnest(p) AS v, unnest(range(len(p))) AS i FROM p),
o AS (SELECT *, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM e)
SELECT doc_id, CAST(e - length(v) AS INT) AS start, CAST(e AS INT) AS "end", regexp_replace(v, '^\s+|\s+$', '', 'g') AS text FROM o WHERE regexp_matches(v, '\S')""",
)
def sentence_split(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.select("doc_id", "s.start", "s.end", "s.text")


@query(
    "context_window",
    r"""WITH f AS (SELECT doc_id, text, instr(lower(text), 'the ') - 1 AS a FROM documents)
SELECT doc_id, a AS start, CASE WHEN a < 0 THEN -1 ELSE a + 4 END AS "end",
  CASE WHEN a >= 0 THEN CASE WHEN a > 100 THEN '...' ELSE '' END || substring(text, greatest(a - 100, 0) + 1, least(a + 104, length(text)) - greatest(a - 100, 0)) || CASE WHEN a + 104 < length(text) THEN '...' ELSE '' END END AS context FROM f""",
)
def context_window(spark, sf_dir):
    v, t = F.lit("the "), F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.find(v, t).alias("f"), T.context(v, t).alias("context")).select("doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), "context")


@query(
    "truncate_text",
    """SELECT doc_id, md5(left(text, 1000)) AS head, md5(right(text, 1000)) AS tail, md5(CASE WHEN length(text) > 1000 THEN left(text, 500) || '<cut>' || right(text, 500) ELSE text END) AS both_ends,
  md5(CASE WHEN length(text) > 2000 THEN left(text, 2000) || '<more>' ELSE text END) AS marked, length(text) // 4 AS tokens, length(text) // 4 <= 900 AS fits FROM documents""",
)
def truncate_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate(t, 1000)).alias("head"), F.md5(T.truncate(t, 1000, "end")).alias("tail"), F.md5(T.truncate(t, 1000, "both", "<cut>")).alias("both_ends"), F.md5(T.truncate_marked(t, 2000, "<more>")).alias("marked"), T.token_estimate(t).alias("tokens"), T.fits(t, 1000).alias("fits"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS["en"]) + "]"


@query(
    "text_advanced",
    # the tables hold no characters that the compatibility form changes
    rf"""SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '\$?\d[\d,]*\.?\d*%?|[\p{{L}}\p{{N}}\p{{M}}_\-]+'), lambda w: NOT list_contains({_STOP}, w)), ' ')) AS form FROM documents""",
)
def text_advanced(spark, sf_dir):
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.advanced(F.col("text"))).alias("form"))


@query(
    "validate_ids",
    r"""WITH v AS (SELECT c_custkey AS k, lpad(CAST(c_custkey * 7919 % 100000000000 AS VARCHAR), 11, '0') AS a, CASE WHEN c_custkey % 5 = 0 THEN '111.111.111-11' ELSE lpad(CAST(c_custkey AS VARCHAR), 11, '0') END AS b,
  lpad(CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 13 ELSE 14 END, '9') AS c, lpad(CAST(c_custkey * 977 AS VARCHAR), 8, '0') AS d, CAST(c_custkey AS VARCHAR) || '-X' AS e FROM customer)
SELECT k, NOT regexp_full_match(a, '(0{11}|1{11}|2{11}|3{11}|4{11}|5{11}|6{11}|7{11}|8{11}|9{11})') AS cpf_a, b <> '111.111.111-11' AS cpf_b, length(c) = 14 AS cnpj, length(d) = 8 AND CAST(d AS BIGINT) >= 1000000 AS cep,
  length(regexp_replace(e, '[^0-9]', '', 'g')) BETWEEN 5 AND 12 AS rg, length(regexp_replace(e, '[^0-9]', '', 'g')) >= 8 AS nire FROM v""",
)
def validate_ids(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    a = F.lpad((k * 7919 % 100000000000).cast("string"), 11, "0")
    b = F.when(k % 5 == 0, "111.111.111-11").otherwise(F.lpad(s, 11, "0"))
    c = F.when(k % 3 == 0, F.lpad(s, 13, "9")).otherwise(F.lpad(s, 14, "9"))
    d, e = F.lpad((k * 977).cast("string"), 8, "0"), F.concat(s, F.lit("-X"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), V.cpf(a).alias("cpf_a"), V.cpf(b).alias("cpf_b"), V.cnpj(c).alias("cnpj"), V.cep(d).alias("cep"), V.rg(e).alias("rg"), V.nire(e).alias("nire"))


@query(
    "validate_registry",
    r"""WITH v AS (SELECT o_orderkey AS k, ['cpf->socio', 'data_registro', 'nome->socio', 'orgao_expedidor_rg', 'outro'][1 + o_orderkey % 5] AS t, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'Ana  ' || o_orderstatus END AS v FROM orders)
SELECT k, CASE WHEN t LIKE 'cpf%' THEN length(regexp_replace(v, '[^0-9]', '', 'g')) = 11 WHEN t LIKE '%rg%' THEN length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 5 AND 12
  WHEN t LIKE 'data%' THEN regexp_matches(v, '\d{2}/\d{2}/\d{4}') WHEN t LIKE 'nome%' THEN v LIKE 'Ana%' ELSE true END AS is_valid FROM v""",
)
def validate_registry(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.element_at(F.array(*[F.lit(x) for x in ("cpf->socio", "data_registro", "nome->socio", "orgao_expedidor_rg", "outro")]), (k % 5 + 1).cast("int"))
    v = F.when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.concat(F.lit("Ana  "), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), V.registry_entity(t, v)["is_valid"].alias("is_valid"))


@query(
    "validate_contract",
    r"""WITH v AS (SELECT o_orderkey AS k, ['PARTY', 'doc_name', 'AGMT_DATE', 'OTHER'][1 + o_orderkey % 4] AS t,
  ['Company', 'the parties', 'SERVICE LETTER ' || o_orderkey, 'TITLE X', strftime(o_orderdate, '%Y-%m-%d'), 'maybe', 'z', 'title y'][1 + (o_orderkey // 4) % 8] AS v FROM orders)
SELECT k, CASE t WHEN 'PARTY' THEN length(v) >= 2 AND v <> 'the parties' WHEN 'doc_name' THEN v LIKE 'SERVICE%' OR v = 'TITLE X' WHEN 'AGMT_DATE' THEN v = 'maybe' OR regexp_matches(v, '^\d{4}-') ELSE true END AS is_valid FROM v""",
)
def validate_contract(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.element_at(F.array(*[F.lit(x) for x in ("PARTY", "doc_name", "AGMT_DATE", "OTHER")]), (k % 4 + 1).cast("int"))
    v = F.element_at(F.array(F.lit("Company"), F.lit("the parties"), F.concat(F.lit("SERVICE LETTER "), k.cast("string")), F.lit("TITLE X"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("maybe"), F.lit("z"), F.lit("title y")), (F.floor(k / 4) % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), V.contract_entity(t, v)["is_valid"].alias("is_valid"))


@query(
    "segment_types",
    "SELECT doc_id, concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{t}' END" for t, ws in SEGMENT_KEYWORDS.items()) + ") AS types FROM documents",
)
def segment_types(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.relevant_types(F.col("text"), SEGMENT_KEYWORDS), ",").alias("types"))


@query(
    "narrow_types",
    """WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS t FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN len(list_filter(t, lambda x: x < '3')) < 2 THEN t[1:2] ELSE list_filter(t, lambda x: x < '3') END, '|') AS own,
  array_to_string((list_filter(t, lambda x: x LIKE '5%') || list_filter(t, lambda x: x NOT LIKE '5%'))[1:3], '|') AS ranked FROM t""",
)
def narrow_types(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("t"))
    names = ["1-URGENT", "2-HIGH"]
    return t.select("o_custkey", F.array_join(V.narrow(F.col("t"), names, 2, 2), "|").alias("own"), F.array_join(V.prioritise(F.col("t"), ["5-LOW"], 3), "|").alias("ranked"))


@query(
    "chunk_stride",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2048) / 1024.0), 0) AS BIGINT) * 1024 + 1, 1024)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(s // 1024 AS INT) AS chunk_id, md5(substring(text, s + 1, 2048)) AS text, CAST(s AS INT) AS start, CAST(least(s + 2048, length(text)) AS INT) AS "end" FROM s""",
)
def chunk_stride(spark, sf_dir):
    return C.explode_chunks(table(spark, sf_dir, "documents"), C.stride(F.col("text"), 2048, 1024), "doc_id").withColumn("text", F.md5("text"))


@query(
    "chunk_words",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 384)) AS s FROM w)
SELECT doc_id, CAST(s // 384 AS INT) AS chunk_id, md5(array_to_string(w[s + 1 : s + 512], ' ')) AS text, CAST(s AS INT) AS start, CAST(least(s + 512, len(w)) AS INT) AS "end" FROM s""",
)
def chunk_words(spark, sf_dir):
    return C.explode_chunks(table(spark, sf_dir, "documents"), C.word_windows(F.col("text")), "doc_id").withColumn("text", F.md5("text"))


@query(
    "chunk_blank",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2040) / 1428.0), 0) AS BIGINT) * 1428 + 1, 1428)) AS s FROM documents WHERE length(text) > 0),
e AS (SELECT *, instr(substring(text, s + 2041), ' ') AS g FROM s),
f AS (SELECT *, CASE WHEN s + 2040 >= length(text) OR g = 0 THEN length(text) ELSE s + 2040 + g - 1 END AS e FROM e)
SELECT doc_id, CAST(s // 1428 AS INT) AS chunk_id, md5(substring(text, s + 1, e - s)) AS text, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM f""",
)
def chunk_blank(spark, sf_dir):
    return C.explode_chunks(table(spark, sf_dir, "documents"), C.blank_extended(F.col("text")), "doc_id").withColumn("text", F.md5("text"))


@query(
    "chunk_full_stop",
    r"""WITH RECURSIVE c AS (
  SELECT doc_id, text, 0 AS k, CAST(0 AS BIGINT) AS s, 0 AS done FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, k + 1, CASE WHEN e >= length(text) THEN e ELSE e - 200 END, CAST(e >= length(text) AS INT) FROM (
    SELECT doc_id, text, k, s, CASE WHEN least(s + 1000, length(text)) < length(text) AND contains(substring(text, s + 1, 1000), '.') AND 999 - instr(reverse(substring(text, s + 1, 1000)), '.') + 1 > 500
      THEN s + 1000 - instr(reverse(substring(text, s + 1, 1000)), '.') + 1 ELSE least(s + 1000, length(text)) END AS e FROM c WHERE done = 0))
SELECT a.doc_id, a.k AS chunk_id, md5(substring(a.text, a.s + 1, b.e - a.s)) AS text, CAST(a.s AS INT) AS start, CAST(b.e AS INT) AS "end"
FROM c a JOIN (SELECT doc_id, k, CASE WHEN done = 1 THEN s ELSE s + 200 END AS e FROM c) b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.done = 0""",
)
def chunk_full_stop(spark, sf_dir):
    return C.explode_chunks(table(spark, sf_dir, "documents"), C.full_stops(F.col("text")), "doc_id").withColumn("text", F.md5("text"))


@query(
    "chunk_capped",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 2048) / 1024.0), 0) AS BIGINT) * 1024 + 1, 1024)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(s // 1024 AS INT) AS chunk_id, md5(substring(text, s + 1, 2048)) AS text, CAST(s AS INT) AS start, CAST(least(s + 2048, length(text)) AS INT) AS "end" FROM s WHERE s < 5 * 1024""",
)
def chunk_capped(spark, sf_dir):
    # at most five windows of a document are this chunker's rule
    return C.explode_chunks(table(spark, sf_dir, "documents"), C.stride(F.col("text"), 2048, 1024, most=5), "doc_id").withColumn("text", F.md5("text"))


def sliding_sql(size, overlap):
    """Common tables up to ``ch`` (doc_id, chunk_id, body, q, e): the sliding chunker's walk as a recursion over starts."""
    window = f"substring(text, s + 1, {size})"
    hit = lambda m: f"length({window}) - instr(reverse({window}), reverse({m})) - 1"
    ends = " ".join(f"WHEN contains({window}, {m}) AND {hit(m)} > {size // 2} THEN s + {hit(m)} + 2" for m in (f"'{c}' || {e}" for c in ".?!" for e in ("' '", "chr(10)")))
    end = f"CASE WHEN s + {size} >= length(text) THEN length(text) {ends} ELSE s + {size} END"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, text, CAST(0 AS BIGINT) AS s FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, e - {overlap} FROM (SELECT doc_id, text, {end} AS e FROM w) WHERE e < length(text)),
ch0 AS (SELECT doc_id, regexp_replace(substring(text, s + 1, {end} - s), '^\\s+|\\s+$', '', 'g') AS body, s AS q, {end} AS e FROM w),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY q) - 1 AS chunk_id, body, q, e FROM ch0 WHERE body <> '')"""


#: Sentences (doc_id, i, v, s, e) of the documents, v stripped, blank ones left out.
SENTENCES_SQL = r"""a0 AS (SELECT doc_id, regexp_extract_all(text, '(?s)(?:.*?[.!?]\s+|.+)') AS p FROM documents),
a1 AS (SELECT doc_id, unnest(p) AS v, unnest(range(len(p))) AS k FROM a0), a2 AS (SELECT doc_id, k, v, sum(length(v)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM a1),
st AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, regexp_replace(v, '^\s+|\s+$', '', 'g') AS v, e - length(v) AS s, e FROM a2 WHERE regexp_replace(v, '^\s+|\s+$', '', 'g') <> '')"""


def _walked(name, chunks, sql=None):
    @query(name, sql)
    def run(spark, sf_dir):
        return C.explode_chunks(table(spark, sf_dir, "documents"), chunks(F.col("text")), "doc_id").withColumn("text", F.md5("text"))


_walked("chunk_sliding", C.sliding, f"""{sliding_sql(512, 128)} SELECT doc_id, CAST(chunk_id AS INT) AS chunk_id, md5(body) AS text, CAST(q AS INT) AS start, CAST(e AS INT) AS "end" FROM ch""")
_walked("chunk_recursive", C.recursive)


@query("chunk_in_pieces", f"""{sliding_sql(512, 128)} SELECT doc_id, CAST(chunk_id AS INT) AS chunk_id, md5(body) AS text, CAST(q AS INT) AS start, CAST(e AS INT) AS "end" FROM ch""")
def chunk_in_pieces(spark, sf_dir):
    """Sliding windows, every text over 4,096 characters in several tasks."""
    return C.chunk_in_pieces(table(spark, sf_dir, "documents"), piece=4096).withColumn("text", F.md5("text"))


_walked(
    "chunk_sentences",
    C.pack_sentences,
    f"""WITH RECURSIVE {SENTENCES_SQL}, r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS c, CAST(0 AS BIGINT) AS used FROM st WHERE i = 1
  UNION ALL SELECT st.doc_id, st.i, CASE WHEN r.used + length(v) > 1024 OR r.c < 0 THEN r.c + 1 ELSE r.c END, CASE WHEN r.used + length(v) > 1024 OR r.c < 0 THEN 0 ELSE r.used END + length(v) + 1 FROM r JOIN st ON st.doc_id = r.doc_id AND st.i = r.i + 1)
SELECT r.doc_id, CAST(c AS INT) AS chunk_id, md5(string_agg(v, ' ' ORDER BY st.i)) AS text, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end" FROM r JOIN st ON st.doc_id = r.doc_id AND st.i = r.i GROUP BY 1, 2""",
)


def _headed(spark, sf_dir):
    """Orders of a customer as lines below headings."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("ARTICLE "), F.col("o_orderkey").cast("string"), F.lit("\n"))).otherwise(""), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")).alias("line"))
    return o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("text"))


_HEADED = """d AS (SELECT o_custkey, string_agg(CASE WHEN o_orderkey % 5 = 0 THEN 'ARTICLE ' || o_orderkey || chr(10) ELSE '' END || o_orderpriority || ' ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1),
l AS (SELECT o_custkey, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM d),
k AS (SELECT *, line LIKE 'ARTICLE %' AS h, sum(length(line) + 1) OVER (PARTITION BY o_custkey ORDER BY no) - length(line) - 1 AS q FROM l),
n AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY o_custkey ORDER BY no) AS s FROM k)"""


@query(
    "sections",
    f"""WITH {_HEADED}
SELECT o_custkey, CAST(s AS INT) AS section_no, 'article' AS kind, first(line ORDER BY no) AS title, string_agg(line, chr(10) ORDER BY no) AS text, CAST(min(q) AS INT) AS start,
  CAST(least(max(q + length(line) + 1), max(length(n.text))) AS INT) AS "end" FROM n WHERE s > 0 GROUP BY o_custkey, s""",
)
def sections(spark, sf_dir):
    return C.sections(_headed(spark, sf_dir), "o_custkey")


def detected_sql(source, key):
    """Common tables up to ``det`` (key, section_no, kind, title, text, start, end): sections by all patterns, or the whole document."""
    kind = " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for p, k in C.HEADINGS_FULL)
    return f"""dl AS (SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM {source}),
dk AS (SELECT *, CASE {kind} END AS kind FROM (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM dl)),
dn AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY {key} ORDER BY no) - length(line) - 1 AS q, count(kind) OVER (PARTITION BY {key} ORDER BY no) AS section_no, count(kind) OVER (PARTITION BY {key}) AS headings FROM dk),
dt AS (SELECT {key}, section_no, coalesce(first(kind ORDER BY no), 'document') AS kind, CASE WHEN first(kind ORDER BY no) IS NULL THEN 'Document' ELSE first(s ORDER BY no) END AS title,
  string_agg(CASE WHEN kind IS NULL THEN line ELSE s END, chr(10) ORDER BY no) AS text, min(q) AS start FROM dn WHERE section_no > 0 OR headings = 0 GROUP BY 1, 2),
det AS (SELECT *, start + length(text) AS "end" FROM dt)"""


_MIXED = """o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '  ARTICLE ' || o_orderkey || ': ends ' || chr(10) WHEN 1 THEN 'Section 3 of it' || chr(10) WHEN 2 THEN '12. Title' || chr(10) WHEN 3 THEN 'IV - Term' || chr(10) WHEN 4 THEN 'GENERAL TERMS:' || chr(10) ELSE '' END || ' ' || o_orderpriority || ' x' AS line FROM orders),
d AS (SELECT o_custkey, string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM o WHERE o_custkey % 3 > 0 OR o_orderkey % 9 > 4 GROUP BY 1)"""


@query("sections_all", f"""WITH {_MIXED}, {detected_sql("d", "o_custkey")} SELECT o_custkey, CAST(section_no AS INT) AS section_no, kind, title, text, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM det""")
def sections_all(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    head = F.when(k == 0, F.concat(F.lit("  ARTICLE "), F.col("o_orderkey").cast("string"), F.lit(": ends \n"))).when(k == 1, "Section 3 of it\n").when(k == 2, "12. Title\n").when(k == 3, "IV - Term\n").when(k == 4, "GENERAL TERMS:\n").otherwise("")
    o = table(spark, sf_dir, "orders").where((F.col("o_custkey") % 3 > 0) | (k > 4)).select("o_custkey", "o_orderkey", F.concat(head, F.lit(" "), "o_orderpriority", F.lit(" x")).alias("line"))
    d = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return C.detect_sections(d, "o_custkey")


_ADD = "list_append(out, {{'t': {0}, 's': {1}, 'e': {2}, 'k': {3}}})"
_HELD = "CASE WHEN held IS NULL THEN body ELSE held || chr(10) || chr(10) || body END"


@query(
    "section_chunks",
    # no section of this table is longer than a chunk may be
    f"""WITH RECURSIVE {_HEADED}, b0 AS (SELECT o_custkey, s AS i, trim(string_agg(line, chr(10) ORDER BY no)) AS body, min(q) AS start, least(max(q + length(line) + 1), max(length(text))) AS e FROM n WHERE s > 0 GROUP BY 1, 2),
r AS (SELECT o_custkey, CAST(0 AS HUGEINT) AS i, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS HUGEINT) AS begin, CAST([] AS STRUCT(t VARCHAR, s HUGEINT, e HUGEINT, k VARCHAR)[]) AS out FROM b0 WHERE i = 1
  UNION ALL SELECT o_custkey, i, CASE WHEN length(body) >= 128 OR length({_HELD}) >= 128 THEN NULL ELSE {_HELD} END, CASE WHEN held IS NULL THEN start ELSE begin END,
    CASE WHEN length(body) >= 128 THEN list_append(CASE WHEN held IS NULL THEN out ELSE {_ADD.format('held', 'begin', 'start', "'merged'")} END, {{'t': body, 's': start, 'e': e, 'k': 'article'}})
      WHEN length({_HELD}) >= 128 THEN {_ADD.format(_HELD, 'CASE WHEN held IS NULL THEN start ELSE begin END', 'e', "'merged'")} ELSE out END
  FROM (SELECT b0.*, r.held, r.begin, r.out FROM r JOIN b0 ON b0.o_custkey = r.o_custkey AND b0.i = r.i + 1)),
f AS (SELECT o_custkey, arg_max(held, i) AS held, arg_max(begin, i) AS begin, arg_max(out, i) AS out, arg_max(h, i) AS h FROM (SELECT *, held IS NOT NULL AS h FROM r) GROUP BY 1), z AS (SELECT o_custkey, max(e) AS e FROM b0 GROUP BY 1),
x AS (SELECT f.o_custkey, CASE WHEN h THEN {_ADD.format('(SELECT first(y.held) FROM r y WHERE y.o_custkey = f.o_custkey AND y.i = (SELECT max(i) FROM r v WHERE v.o_custkey = f.o_custkey))', '(SELECT first(y.begin) FROM r y WHERE y.o_custkey = f.o_custkey AND y.i = (SELECT max(i) FROM r v WHERE v.o_custkey = f.o_custkey))', 'z.e', "'merged'")} ELSE out END AS out FROM f JOIN z USING (o_custkey)),
u AS (SELECT o_custkey, unnest(out) AS c, unnest(range(len(out))) AS chunk_id FROM x)
SELECT o_custkey, CAST(chunk_id AS INT) AS chunk_id, c.t AS text, CAST(c.s AS INT) AS start, CAST(c.e AS INT) AS "end", c.k AS kind FROM u""",
)
def section_chunks(spark, sf_dir):
    return C.section_chunks(C.sections(_headed(spark, sf_dir), "o_custkey"), "o_custkey")


_VECTOR = "list_append(list_transform(range(97, 123), lambda c: CAST(length(lower(v)) - length(replace(lower(v), chr(CAST(c AS INT)), '')) AS DOUBLE)), 1.0)"
_CUT = "(r.c < 0 OR r.size + length(v) > 1024 OR (cos < 0.7 AND r.size >= 256))"


@query(
    "chunk_semantic",
    f"""WITH RECURSIVE {SENTENCES_SQL}, sv AS (SELECT *, {_VECTOR} AS x FROM st), sc AS (SELECT *, coalesce(list_cosine_similarity(x, lag(x) OVER (PARTITION BY doc_id ORDER BY i)), 1.0) AS cos FROM sv),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS c, CAST(0 AS BIGINT) AS size FROM sc WHERE i = 1
  UNION ALL SELECT sc.doc_id, sc.i, CASE WHEN {_CUT} THEN r.c + 1 ELSE r.c END, CASE WHEN {_CUT} THEN 0 ELSE r.size END + length(v) + 1 FROM r JOIN sc ON sc.doc_id = r.doc_id AND sc.i = r.i + 1)
SELECT r.doc_id, CAST(c AS INT) AS chunk_id, md5(string_agg(v, ' ' ORDER BY st.i)) AS text, CAST(min(s) AS INT) AS start, CAST(max(e) AS INT) AS "end" FROM r JOIN st ON st.doc_id = r.doc_id AND st.i = r.i GROUP BY 1, 2""",
)
def chunk_semantic(spark, sf_dir):
    from quillspan.operators.providers import embedder

    return C.semantic_chunks(table(spark, sf_dir, "documents"), "doc_id", embedder("letters")).withColumn("text", F.md5("text"))


@query(
    "token_windows",
    r"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents),
s AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(ceil((n - 510) / 382.0), 0) AS BIGINT) * 382 + 1, 382)) AS s FROM n WHERE n > 0)
SELECT doc_id, CAST(s AS INT) AS first, CAST(least(s + 510, n) AS INT) AS "end" FROM s WHERE s < 382 * 50""",
)
def token_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", V.n_words(F.col("text")).alias("n"))
    return d.select("doc_id", F.explode(C.token_windows(F.col("n"), 510, 382)).alias("w")).select("doc_id", "w.first", "w.end")


@query(
    "dataset_stats",
    """SELECT lang, count(*) AS documents, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars, min(n_chars % 7) AS min_entities, max(n_chars % 7) AS max_entities, round(avg(n_chars % 7), 6) AS mean_entities FROM documents GROUP BY 1""",
)
def dataset_stats(spark, sf_dir):
    from quillspan.operators.evaluate import dataset_statistics

    df = dataset_statistics(table(spark, sf_dir, "documents").withColumn("n_entities", F.col("n_chars") % 7), "lang")
    return df.select(*[rounded(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in df.columns])
