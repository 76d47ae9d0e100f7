"""Retrieval within each document: dense, BM25, TF-IDF, fusion, top-k.

Corpora are per document: every statistic is grouped by ``key``, every join
carries it.  Ties of a score are broken by the smaller chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import once, tokens
from quillspan.operators.dense import search

# What is searched for each type.
TYPE_QUERIES = {
    "Party": "contracting parties names companies buyer seller",
    "Date": "agreement date effective date execution date signed",
    "Governing Law": "governing law applicable law jurisdiction governed by",
    "Jurisdiction": "jurisdiction courts disputes resolution venue",
    "Termination Clause": "termination terminate end agreement cancellation",
    "Renewal Term": "renewal auto-renewal extension term",
    "Notice Period": "notice days prior written notice notification",
    "Non-Compete Term": "non-compete competition restriction covenant",
    "Exclusivity": "exclusive exclusivity sole rights",
    "CONTRATANTE": "contratante parte contratação empresa",
    "CONTRATADA": "contratada prestadora fornecedor empresa",
    "CNPJ_CONTRATANTE": "CNPJ inscrita contratante número",
    "CNPJ_CONTRATADA": "CNPJ inscrita contratada prestadora",
    "DATA_CONTRATO": "data assinatura celebrado firmado",
    "VALOR_CONTRATO": "valor preço remuneração pagamento R$",
    "PRAZO_VIGENCIA": "prazo vigência duração período meses",
    "OBJETO_CONTRATO": "objeto contratação prestação serviço",
    "FORO": "foro comarca eleito jurisdição",
}


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each group with their rank from 1; Spark prunes to k per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie).asc()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_score(a: Column, b: Column, measure: str = "cosine") -> Column:
    """cosine (norms floored at 1e-10), dot product, or 1 / (1 + Euclidean distance)."""
    if measure == "cosine":
        return _dot(a, b) / F.greatest(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(1e-10))
    if measure == "dot":
        return _dot(a, b)
    if measure == "l2":
        return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)))
    raise ValueError(f"unknown measure {measure}")


def dense(chunks: DataFrame, queries: DataFrame, on: str, k: int = 5, measure: str = "cosine", least: float | None = 0.3) -> DataFrame:
    """Top-k chunks (on, chunk_id, vector) of each query (on, query_id, query_vector) in its group, then those of ``least`` or more.

    By ``dense.search``: each block of vectors gives k rows a query at most.
    """
    best = top_k(search(chunks, queries, on, k, measure), [on, "query_id"], k)
    return best if least is None else best.where(F.col("score") >= least)


def bm25(chunks: DataFrame, queries: DataFrame, on: str, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(on, query_id, chunk_id, score) with a score above 0; negative idf become ``floor`` times the group's mean; repeated query words count."""
    words = chunks.select(on, "chunk_id", tokens(F.col("text")).alias("w"))
    size = words.select(on, "chunk_id", F.size("w").alias("dl"))
    group = size.groupBy(on).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = words.select(on, "chunk_id", F.explode("w").alias("w")).groupBy(on, "chunk_id", "w").agg(F.count("*").alias("tf"))
    idf = tf.groupBy(on, "w").agg(F.count("*").alias("df")).join(group, on).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(on).agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(mean, on).select(on, "w", "avgdl", F.when(F.col("raw") < 0, floor * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.select(on, "query_id", F.explode(tokens(F.col("query"))).alias("w")).groupBy(on, "query_id", "w").agg(F.count("*").alias("qf"))
    hit = asked.join(idf, [on, "w"]).join(tf, [on, "w"]).join(size, [on, "chunk_id"])
    part = F.col("qf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(on, "query_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")


def _grams(text: Column) -> Column:
    """Lower-cased words of two characters or more, and pairs of neighbours."""

    def pairs(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))

    # the words are found once: a text searched anew for each pair costs the square of its length
    return once(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: F.concat(w, pairs(w)))


def tfidf(chunks: DataFrame, queries: DataFrame, on: str, features: int = 10_000) -> DataFrame:
    """(on, query_id, chunk_id, score): cosine of tf-idf vectors of words and pairs, above 0; smoothed idf ln((1+n)/(1+df)) + 1.

    The vocabulary of a group is its ``features`` most frequent grams.
    """
    grams = chunks.select(on, "chunk_id", F.explode(_grams(F.col("text"))).alias("w")).groupBy(on, "chunk_id", "w").agg(F.count("*").alias("tf"))
    n = chunks.groupBy(on).agg(F.count("*").alias("n"))
    vocab = grams.groupBy(on, "w").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    vocab = vocab.withColumn("r", F.row_number().over(Window.partitionBy(on).orderBy(F.col("total").desc(), "w"))).where(F.col("r") <= features)
    idf = vocab.join(n, on).select(on, "w", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    docs = grams.join(idf, [on, "w"]).select(on, "chunk_id", "w", (F.col("tf") * F.col("idf")).alias("x"))
    norm = docs.groupBy(on, "chunk_id").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("dn"))
    asked = queries.select(on, "query_id", F.explode(_grams(F.col("query"))).alias("w")).groupBy(on, "query_id", "w").agg(F.count("*").alias("qf"))
    asked = asked.join(idf, [on, "w"]).select(on, "query_id", "w", (F.col("qf") * F.col("idf")).alias("y"))
    qnorm = asked.groupBy(on, "query_id").agg(F.sqrt(F.sum(F.col("y") ** 2)).alias("qn"))
    dot = docs.join(asked, [on, "w"]).groupBy(on, "query_id", "chunk_id").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dot.join(norm, [on, "chunk_id"]).join(qnorm, [on, "query_id"]).select(on, "query_id", "chunk_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score")).where("score > 0")


def fuse(first: DataFrame, second: DataFrame, on: list[str], weights: tuple[float, float] = (0.7, 0.3), constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (on..., chunk_id, rank from 1): score = sum of weight / (constant + rank)."""
    parts = [df.select(*on, "chunk_id", (F.lit(w) / (constant + F.col("rank"))).alias("p")) for df, w in zip((first, second), weights, strict=True)]
    return parts[0].unionByName(parts[1]).groupBy(*on, "chunk_id").agg(F.sum("p").alias("score"))


def hybrid(dense_scores: DataFrame, sparse_scores: DataFrame, on: list[str], k: int = 5) -> DataFrame:
    """Top-k of the fusion of the best int(1.5 k) of either side."""
    wide = int(1.5 * k)
    return top_k(fuse(top_k(dense_scores, on, wide), top_k(sparse_scores, on, wide), on), on, k)


def rerank(found: DataFrame, on: list[str], scorer: Column, k: int = 5) -> DataFrame:
    """Order candidates by a scorer (a model's Arrow UDF, or any expression) and keep k."""
    return top_k(found.drop("rank").withColumn("score", scorer), on, k)


def type_queries(types: DataFrame) -> DataFrame:
    """(type, query): the template of a type, or its name."""
    known = F.create_map(*[F.lit(x) for kv in TYPE_QUERIES.items() for x in kv])
    return types.select("type", F.coalesce(F.try_element_at(known, F.col("type")), F.col("type")).alias("query"))


def build_context(found: DataFrame, by: list[str]) -> DataFrame:
    """(by..., context): chunks in rank order, numbered."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x, i: F.concat(F.lit("[Trecho "), (i + 1).cast("string"), F.lit("]\n"), x["text"]))
    return found.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("context"))


def first_chunks(chunks: Column, n: int | Column = 5, most: int = 12_000) -> Column:
    """The first ``n`` chunks as one text, cut at ``most`` characters."""
    return F.substr(F.array_join(F.slice(F.transform(chunks, lambda c: c["text"]), 1, n), "\n\n"), F.lit(1), F.lit(most))


def batches(types: DataFrame, size: int = 10) -> DataFrame:
    """(batch, types): types (pos, type) in groups of ``size``."""
    return types.groupBy(F.floor(F.col("pos") / size).cast("int").alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]).alias("types"))


def select_demos(pool: DataFrame, n: int = 3, aim: int = 100) -> DataFrame:
    """Demonstrations (type, doc_id, seq, text) nearest to ``aim`` characters, a document's first before its others."""
    near = [F.abs(F.char_length("text") - aim), F.col("seq")]
    pool = pool.where(F.char_length("text") > 5).withColumn("dup", F.row_number().over(Window.partitionBy("type", "doc_id").orderBy(*near)))
    return pool.withColumn("r", F.row_number().over(Window.partitionBy("type").orderBy(F.col("dup") > 1, *near))).where(F.col("r") <= n).drop("dup")


def flat_contexts(text: Column, model, queries: list[str], k: int = 5, size: int = 512, overlap: int = 128, bypass: int = 1000) -> Column:
    """array<string>: for each query the best ``k`` word windows of a text by cosine, best first, joined by a blank.

    A text of fewer than ``bypass`` words is its own context.  Windows,
    vectors and their flat index belong to one document, so nothing is
    shuffled; the queries are a stated, small list.
    """
    step = size - overlap

    @F.arrow_udf("array<string>")
    def run(texts):
        import numpy as np
        import pyarrow as pa

        from quillspan.operators.providers import embed_batch

        def unit(vectors):
            v = np.asarray(vectors, float).reshape(len(vectors), -1)
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

        asked = unit(embed_batch(model, [getattr(model, "query_prefix", "") + q for q in queries]))
        out = []
        for t in texts.to_pylist():
            words = (t or "").split()
            if len(words) < bypass:
                out.append([t or ""] * len(queries))
                continue
            parts = [" ".join(words[i : i + size]) for i in range(0, len(words), step)]
            score = np.round(asked @ unit(embed_batch(model, [getattr(model, "passage_prefix", "") + p for p in parts])).T, 9)
            # ties by the earlier window
            out.append([" ".join(parts[i] for i in np.lexsort((np.arange(len(parts)), -row))[:k]) for row in score])
        return pa.array(out, pa.list_(pa.string()))

    return run(text)


RETRIEVERS = ("dense", "bm25", "tfidf", "hybrid")


def retriever(name: str, model=None, k: int = 5):
    """A function (chunks, queries, key) -> ranked chunks by name: chunks (key, chunk_id, text), queries (key, query_id, query).

    ``dense`` and ``hybrid`` (dense and BM25, fused) need an embedder.
    """
    from quillspan.operators.providers import embed

    if name not in RETRIEVERS:
        raise ValueError(f"unknown retriever {name}; known: {', '.join(RETRIEVERS)}")
    if name in ("dense", "hybrid") and model is None:
        raise ValueError(f"{name} needs an embedder")

    def by_vectors(chunks: DataFrame, queries: DataFrame, key: str, most: int) -> DataFrame:
        c = chunks.select(key, "chunk_id", embed(F.col("text"), model).alias("vector"))
        q = queries.select(key, "query_id", embed(F.col("query"), model, query=True).alias("query_vector"))
        return dense(c, q, key, most, "cosine", None).withColumn("score", F.round("score", 9))

    def run(chunks: DataFrame, queries: DataFrame, key: str) -> DataFrame:
        on = [key, "query_id"]
        if name == "dense":
            return by_vectors(chunks, queries, key, k)
        if name == "hybrid":
            return hybrid(by_vectors(chunks, queries, key, int(1.5 * k)), bm25(chunks, queries, key), on, k)
        return top_k((bm25 if name == "bm25" else tfidf)(chunks, queries, key), on, k)

    return run
