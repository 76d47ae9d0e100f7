"""Readers of annotation files: nested question-answer JSON, JSON lists, JSON lines with span triples.

All return documents (doc_id, text, annotations array<struct<type,value,start,end>>) or rows exploded from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import clause_type

ANSWERS = "array<struct<text:string,answer_start:int>>"
QA = f"struct<data:array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<question:string,is_impossible:boolean,answers:{ANSWERS}>>>>>>>"
ITEM = "id string, text string, context string, content string, label array<array<string>>, labels array<array<string>>, annotations array<struct<type:string,label:string,value:string,text:string,start:int,end:int>>, entities array<struct<type:string,label:string,value:string,text:string,start:int,end:int>>, metadata map<string,string>"

# Keywords of questions with the type they stand for; the first that occurs decides.
QUESTION_TYPES = [("parties", "Party"), ("agreement date", "Date"), ("effective date", "Date"), ("expiration date", "Date"), ("renewal term", "Renewal Term"), ("notice period", "Notice Period"), ("governing law", "Governing Law"), ("jurisdiction", "Jurisdiction"), ("termination", "Termination Clause"), ("non-compete", "Non-Compete Term"), ("exclusivity", "Exclusivity")]
# Names that a split's file may have, in order.
SPLIT_FILES = ("{}.json", "CUADv1_{}.json", "cuad_{}.json")


def question_type(q: Column) -> Column:
    low = F.lower(q)
    out = F.lit("Other")
    for word, kind in reversed(QUESTION_TYPES):
        out = F.when(low.contains(word), kind).otherwise(out)
    return out


def question_code(q: Column) -> Column:
    """A second set of rules: TERM comes before TERMINATION, which is left for questions that name non-compete too."""
    low = F.lower(q)
    has = low.contains
    return (
        F.when(has("parties") | has("party"), "PARTY")
        .when(has("agreement name") | has("document name"), "DOC_NAME")
        .when(has("agreement date") | has("effective date"), "AGMT_DATE")
        .when(has("governing law"), "GOVERNING_LAW")
        .when(has("term") & ~has("non-compete"), "TERM")
        .when(has("termination"), "TERMINATION")
        .when(has("renewal"), "RENEWAL")
        .when(has("notice"), "NOTICE_PERIOD")
        .when(has("non-compete"), "NON_COMPETE")
        .when(has("exclusive"), "EXCLUSIVITY")
        .otherwise("OTHER")
    )


def question_clause(q: Column, vocabulary: list[str] | None = None) -> Column:
    """The clause a question relates to, upper case with underscores; null outside the vocabulary."""
    c = clause_type(F.nullif(F.regexp_extract(q, r'related to "([^"]+)"', 1), F.lit("")))
    return F.when(c.isin(vocabulary), c) if vocabulary else c


def quoted_clause(q: Column) -> Column:
    """The first quoted string of a question as a clause name."""
    return clause_type(F.nullif(F.regexp_extract(q, r'"([^"]+)"', 1), F.lit("")))


def split_path(spark: SparkSession, folder: str, split: str) -> str:
    """The first existing file of a split."""
    jvm = spark.sparkContext._jvm
    for name in SPLIT_FILES:
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.format(split)}")
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return p.toString()
    raise FileNotFoundError(f"no file of split {split} in {folder}")


def paragraphs(raw: DataFrame) -> DataFrame:
    """(title, para, text, qas) from parsed question-answer files."""
    d = raw.select(F.explode("data").alias("d")).select("d.title", F.posexplode("d.paragraphs").alias("para", "p"))
    return d.select("title", "para", F.col("p.context").alias("text"), F.col("p.qas").alias("qas"))


def answers(paras: DataFrame, kind=question_type) -> DataFrame:
    """One row per answer with text: (title, para, question, type, value, start, end); impossible questions are skipped."""
    qa = paras.select("title", "para", F.explode("qas").alias("q")).where(~F.coalesce("q.is_impossible", F.lit(False)))
    a = qa.select("title", "para", F.col("q.question").alias("question"), F.posexplode("q.answers").alias("seq", "a")).where("a.text <> ''")
    start = F.col("a.answer_start")
    return a.select("title", "para", "seq", "question", kind(F.col("question")).alias("type"), F.col("a.text").alias("value"), start.alias("start"), (F.coalesce(start, F.lit(0)) + F.char_length("a.text")).alias("end"))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs(spark.read.option("multiLine", True).schema(QA[len("struct<"):-1].replace("data:", "data ", 1)).json(path))


def gold_by_type(paras: DataFrame, kind=question_clause, keep_empty: bool = True) -> DataFrame:
    """(doc_id, text, gold map<type, array<value>>): id is title and paragraph; documents without gold stay if ``keep_empty``."""
    docs = paras.select(F.concat_ws("_", "title", F.col("para").cast("string")).alias("doc_id"), "text")
    a = answers(paras, kind).where("type is not null").groupBy(F.concat_ws("_", "title", F.col("para").cast("string")).alias("doc_id"), "type").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("v"))
    g = a.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "v")))).alias("gold"))
    return docs.join(g, "doc_id", "left" if keep_empty else "inner")


def triples(spans: Column, text: Column, strict: bool = False) -> Column:
    """[[start, end, type], ...] as structs; value = text[start:end].  ``strict``: "" unless start and end lie inside the text."""
    n = F.char_length(text)

    def one(x: Column) -> Column:
        s, e = F.try_element_at(x, F.lit(1)).try_cast("int"), F.try_element_at(x, F.lit(2)).try_cast("int")
        value = F.substr(text, s + 1, F.greatest(e - s, F.lit(0)))
        value = F.when((s < n) & (e <= n), value).otherwise("") if strict else value
        return F.struct(F.try_element_at(x, F.lit(3)).alias("type"), value.alias("value"), s.alias("start"), e.alias("end"))

    made = F.transform(spans, one)
    return made if strict else F.filter(made, lambda x: x["start"] < n)


def documents(items: DataFrame, strict: bool = False, keep_empty: bool = True, types: list[str] | None = None) -> DataFrame:
    """Documents from items of any of the accepted shapes (ITEM's columns)."""
    text = F.coalesce("text", "context", "content", F.lit(""))
    named = lambda c: F.transform(c, lambda x: F.struct(F.coalesce(x["type"], x["label"]).alias("type"), F.coalesce(x["value"], x["text"]).alias("value"), x["start"].alias("start"), x["end"].alias("end")))
    found = F.coalesce(triples(F.coalesce("label", "labels"), text, strict), named(F.col("annotations")), named(F.col("entities")), F.array().cast("array<struct<type:string,value:string,start:int,end:int>>"))
    if types:
        found = F.filter(found, lambda x: x["type"].isin(types))
    out = items.select(F.col("id").alias("doc_id"), text.alias("text"), found.alias("annotations"), "metadata")
    return out if keep_empty else out.where((F.col("text") != "") & (F.size("annotations") > 0))


def read_items(spark: SparkSession, path: str, lines: bool | None = None, **options) -> DataFrame:
    """Documents from a JSON list (``lines`` False), JSON lines (True), or either by the file's first character (None)."""
    if lines is None:
        first = spark.read.text(path).where(F.trim("value") != "").select(F.substr(F.trim("value"), F.lit(1), F.lit(1))).first()
        lines = bool(first) and first[0] == "{"
    return documents(spark.read.option("multiLine", not lines).schema(ITEM).json(path), **options)


def with_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """One DataFrame with a split column; ``val`` is another name of ``validation``."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit({"val": "validation"}.get(name, name)))
        out = df if out is None else out.unionByName(df)
    return out


def of_split(df: DataFrame, split: str) -> DataFrame:
    split = {"val": "validation"}.get(split, split)
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown split {split}")
    return df.where(F.col("split") == split)


def entity_types(docs: DataFrame) -> DataFrame:
    """Distinct annotation types, sorted."""
    return docs.select(F.explode("annotations.type").alias("type")).distinct().orderBy("type")


def having_types(docs: DataFrame, types: list[str]) -> DataFrame:
    """Documents with one of the types at least."""
    return docs.where(F.exists("annotations", lambda a: a["type"].isin(types)))


def latest_results(files: DataFrame, prefix: str) -> DataFrame:
    """Of result files (path) named prefix_yyyyMMdd_HHmmss... those with the newest stamp."""
    stamped = files.withColumn("stamp", F.regexp_extract("path", prefix + r"_.*?(\d{8}_\d{6})", 1)).where("stamp <> ''")
    newest = stamped.agg(F.max("stamp").alias("stamp"))
    return stamped.join(F.broadcast(newest), "stamp").withColumn("ts", F.to_timestamp("stamp", "yyyyMMdd_HHmmss"))
