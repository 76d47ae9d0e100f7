"""Sequence labels: vocabularies, encoding, decoding, class weights, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "array<struct<type:string,start:int,end:int,confidence:double>>"


def labels(types: list[str], scheme: str = "BIO", by_type: bool = True) -> list[str]:
    """O, then B- and I- (and E-, S-) labels, type by type or prefix by prefix."""
    marks = {"BIO": "BI", "BIOES": "BIES"}[scheme]
    return ["O", *([f"{m}-{t}" for t in types for m in marks] if by_type else [f"{m}-{t}" for m in marks for t in types])]


def encode(tokens: DataFrame, entities: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, pos, start, end, label) for tokens (key, pos, start, end) and entities (key, seq, type, start, end).

    A token inside an entity is B for the first such token (``strict``: if it
    starts where the entity does), else I; of several entities the last counts.
    """
    e = entities.select(key, "seq", "type", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    hit = tokens.join(e, key).where("start >= e_start and end <= e_end")
    first = F.col("start") == F.col("e_start") if strict else F.row_number().over(Window.partitionBy(key, "seq").orderBy("pos")) == 1
    hit = hit.select(key, "pos", "seq", F.concat(F.when(first, "B-").otherwise("I-"), "type").alias("label"))
    last = hit.groupBy(key, "pos").agg(F.max_by("label", "seq").alias("label"))
    return tokens.join(last, [key, "pos"], "left").select(key, "pos", "start", "end", F.coalesce("label", F.lit("O")).alias("label"))


def decode(tokens: DataFrame, key: str, orphans: str = "start") -> DataFrame:
    """(key, spans) from tokens (key, pos, start, end, label, confidence); a sequence is one group, confidence the least of its tokens.

    What an I without its B does: ``start`` begins an entity, ``skip`` is
    passed over and leaves an open entity open, ``close`` ends the open one.
    """
    seq = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "label", "confidence"))).alias("t"))
    one = SPAN.removeprefix("array<").removesuffix(">")
    # the last span is kept apart: those before it are copied only when one is added to them
    zero = F.struct(F.array().cast(SPAN).alias("out"), F.lit(None).cast(one).alias("last"), F.lit(False).alias("open"))

    def add(s: Column, t: Column) -> Column:
        mark, kind, last = F.substring(t["label"], 1, 2), F.substring(t["label"], 3, 1000), s["last"]
        goes_on = (mark == "I-") & s["open"] & F.coalesce(last["type"] == kind, F.lit(False))
        orphan = (mark == "I-") & ~goes_on
        begins = (mark == "B-") | (orphan if orphans == "start" else F.lit(False))
        begin = F.struct(kind.alias("type"), t["start"].alias("start"), t["end"].alias("end"), t["confidence"].alias("confidence"))
        grown = F.struct(last["type"].alias("type"), last["start"].alias("start"), t["end"].alias("end"), F.least(last["confidence"], t["confidence"]).alias("confidence"))
        out = F.when(begins & last.isNotNull(), F.concat(s["out"], F.array(last))).otherwise(s["out"])
        open_ = F.when(goes_on | (mark == "B-"), True).when(orphan, F.lit(True) if orphans == "start" else s["open"] if orphans == "skip" else F.lit(False)).otherwise(False)
        return F.struct(out.cast(SPAN).alias("out"), F.when(goes_on, grown).when(begins, begin).otherwise(last).cast(one).alias("last"), open_.alias("open"))

    spans = F.aggregate("t", zero, add, lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"]))))
    return seq.select(key, spans.alias("spans"))


def class_weights(entities: DataFrame, documents: DataFrame, types: list[str]) -> DataFrame:
    """(label, weight): inverse frequency over the mean, within 0.1 and 10; words, entities and their further words are counted.  Without any, all weights are 1."""
    n_words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    o = documents.agg(F.coalesce(F.sum(n_words(F.col("text"))), F.lit(0)).alias("n")).select(F.lit("O").alias("label"), "n")
    each = entities.where(F.col("type").isin(types)).groupBy("type").agg(F.count("*").alias("b"), F.sum(F.greatest(n_words(F.col("value")) - 1, F.lit(1))).alias("i"))
    marked = each.select(F.explode(F.array(F.struct(F.concat(F.lit("B-"), "type").alias("label"), F.col("b").alias("n")), F.struct(F.concat(F.lit("I-"), "type").alias("label"), F.col("i").alias("n")))).alias("x")).select("x.*")
    # the label table has one row for each label, the totals one row: nothing here grows with the data
    counts = documents.sparkSession.createDataFrame([(x,) for x in labels(types)], "label string").join(o.unionByName(marked), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    raw = counts.join(F.broadcast(total)).select("label", (F.col("total") / (F.lit(len(labels(types))) * F.col("n") + 1)).alias("w"))
    return raw.join(F.broadcast(raw.agg(F.avg("w").alias("m")))).select("label", F.least(F.greatest(F.when(F.col("m") > 0, F.col("w") / F.col("m")).otherwise(1.0), F.lit(0.1)), F.lit(10.0)).alias("weight"))


def split_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A place for each row in a seeded order by hash: ``r`` from 1, and the number of rows ``n``; rows of one key keep together.

    The order is that of md5(seed:key).  Rows are numbered within 65,536
    buckets of its first four digits and the buckets' totals, a table of
    bounded size, are added up; no task sees more than a bucket.
    """
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))).withColumn("_b", F.substr("_h", F.lit(1), F.lit(4)))
    totals = rows.groupBy("_b").agg(F.count("*").alias("c"))
    totals = totals.select("_b", (F.sum("c").over(Window.orderBy("_b")) - F.col("c")).alias("_base"), F.sum("c").over(Window.partitionBy()).alias("n"))
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(F.broadcast(totals), "_b")
    return placed.withColumn("r", F.col("_base") + F.col("_r")).drop("_h", "_b", "_base", "_r").select(*df.columns, "r", "n")


def train_validation(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split: validation for the first int(n * share) rows of the seeded order, else train."""
    placed = split_order(df, key, seed)
    return placed.withColumn("split", F.when(F.col("r") <= F.floor(F.col("n") * share), "validation").otherwise("train")).drop("r", "n")


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0 .. k - 1 of equal sizes in the seeded order; the last takes what is left over."""
    placed = split_order(df, key, seed)
    return placed.withColumn("fold", F.least(F.floor((F.col("r") - 1) / F.greatest(F.floor(F.col("n") / k), F.lit(1))), F.lit(k - 1)).cast("int")).drop("r", "n")


def histogram(entities: DataFrame, most: int = 10) -> DataFrame:
    """(type, n): the ``most`` most frequent types, ties by name."""
    return entities.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").limit(most)


def entity_scores(tokens: DataFrame, key: str, true: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Entity-level scores of label sequences: both columns are decoded to spans, which count if type, start and end agree."""
    from quillspan.operators.evaluate import exact_spans

    def spans(label: str) -> DataFrame:
        own = tokens.select(key, "pos", "start", "end", F.col(label).alias("label"), F.lit(1.0).alias("confidence"))
        return decode(own, key).select(F.col(key).alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.type", "s.start", "s.end")

    return exact_spans(spans(pred), spans(true), by)
