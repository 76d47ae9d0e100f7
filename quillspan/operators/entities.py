"""Sets of entities: duplicates, votes, overlaps, merging.

Rows carry ``seq``, their place in the input, so "first" is well defined; ``key`` is usually the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.similarity import EPSILON, sequence_at_least
from quillspan.functions.text import simple, strip, word_set
from quillspan.operators import matching
from quillspan.sources.shared import fresh_folder, save

def norm_key(value: Column) -> Column:
    return F.lower(strip(value))


def dedup_first(df: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """The first of equal (type, value); values compared in lower case without outer blanks unless ``exact``."""
    v = F.col("value") if exact else norm_key(F.col("value"))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "type", v).orderBy("seq"))).where("_r = 1").drop("_r")


def dedup_best(df: DataFrame, key: str) -> DataFrame:
    """The one of highest confidence of equal (type, value), the first of ties."""
    w = Window.partitionBy(key, "type", norm_key(F.col("value"))).orderBy(F.col("confidence").desc(), "seq")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _by(df: DataFrame, key: str):
    return df.withColumn("value_key", norm_key(F.col("value"))).groupBy(key, "type", "value_key")


def _surest() -> Column:
    """The value as the most confident of a group spells it, the first of ties."""
    return F.max_by("value", F.struct("confidence", -F.col("seq"))).alias("value")


def majority_vote(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Entities that occur ``least`` times (repeats of one model count), as the most confident one; confidence = occurrences / models of the document."""
    models = df.groupBy(key).agg(F.count_distinct("model").alias("models"))
    votes = _by(df, key).agg(F.count("*").alias("votes"), _surest()).where(F.col("votes") >= least)
    return votes.join(models, key).select(key, "type", "value", "votes", (F.col("votes") / F.col("models")).alias("confidence"))


def weighted_vote(df: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """Confidences added up and capped at 1; the value as the most confident one."""
    got = _by(df, key).agg(F.sum("confidence").alias("s"), _surest())
    return got.where(F.col("s") >= least).select(key, "type", "value", F.least("s", F.lit(1.0)).alias("confidence"))


def ensemble(df: DataFrame, weights: DataFrame, key: str, method: str = "vote") -> DataFrame:
    """Entities of several models, confidences times the model's weight, then joined by ``vote``, ``weighted_vote``, ``confidence_max`` or ``union``.

    ``union`` goes through the entities from the most confident on, so it keeps the same ones as ``confidence_max``;
    any other method is the weighted vote.
    """
    # the weight table has a row per model: joined by key, a few models would be a few tasks with all rows
    df = df.join(F.broadcast(weights), "model", "left").withColumn("confidence", F.col("confidence") * F.coalesce("weight", F.lit(1.0))).drop("weight")
    return {"vote": majority_vote, "confidence_max": dedup_best, "union": dedup_best}.get(method, weighted_vote)(df, key)


def self_consistency(df: DataFrame, key: str, runs: int, share: float = 0.5, places: bool = False) -> DataFrame:
    """Entities in int(runs * share) runs or more (one of two for three runs); confidence = mean of each run's first, times the share of runs, 0.99 at most.

    The last run's value is kept, and with ``places`` its start and end too.
    """
    kept = ["value", "start", "end"] if places else ["value"]
    df = df.withColumn("value_key", norm_key(F.col("value")))
    once = df.groupBy(key, "type", "value_key", "run").agg(F.min_by(F.struct("confidence", *kept), "seq").alias("f"))
    last = F.max_by(F.struct(*(f"f.{c}" for c in kept)), "run").alias("l")
    got = once.groupBy(key, "type", "value_key").agg(F.count("*").alias("votes"), F.avg("f.confidence").alias("mean"), last)
    return got.where(F.col("votes") >= int(runs * share)).select(key, "type", "l.*", "votes", F.least(F.col("mean") * F.col("votes") / runs, F.lit(0.99)).alias("confidence"))


def prompt_consistency(df: DataFrame, key: str, runs: int, union: bool = False) -> DataFrame:
    """Entities in more than half of the runs (any, if ``union``), the last example kept; confidence = share of runs."""
    got = _by(df, key).agg(F.count("*").alias("votes"), F.max_by("value", "seq").alias("value")).where(F.col("votes") >= (1 if union else runs // 2 + 1))
    return got.select(key, "type", "value", "votes", (F.col("votes") / runs).alias("confidence"))


def vote_first(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Entities with ``least`` occurrences, as first seen."""
    got = _by(df, key).agg(F.count("*").alias("votes"), F.min_by(F.struct("value", "confidence"), "seq").alias("f")).where(F.col("votes") >= least)
    return got.select(key, "type", "f.value", "votes", "f.confidence")


def merge_validation(found: DataFrame, confirmed: DataFrame, key: str, keep: float = 0.8, raised: float = 0.9) -> DataFrame:
    """What a second reply repeats is validated and gets ``raised`` confidence at least; of the rest what has ``keep`` or more stays."""
    ok = confirmed.select(key, "type", norm_key(F.col("value")).alias("value_key")).distinct().withColumn("validated", F.lit(True))
    both = found.withColumn("value_key", norm_key(F.col("value"))).join(ok, [key, "type", "value_key"], "left")
    both = both.withColumn("validated", F.coalesce("validated", F.lit(False))).where(F.col("validated") | (F.col("confidence") >= keep))
    return both.withColumn("confidence", F.when(F.col("validated"), F.greatest("confidence", F.lit(raised))).otherwise(F.col("confidence"))).drop("value_key")


def _span_order(key: str) -> list[Column]:
    return [F.col(key), F.col("start").asc_nulls_first(), F.col("end").desc_nulls_first(), F.col("seq")]


def _fold_spans(df: DataFrame, key: str, step) -> DataFrame:
    """The rows of ``df`` that stay when each key's spans go through ``step`` by start, longest first.

    ``step(active, span)`` changes the list of kept spans that still can meet
    another one, and returns the one it replaces, the span itself if it goes,
    or None.  Rows stream through sorted partitions: a task holds the active
    spans, one as a rule, and the batches that they are in.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        waiting, first, active, now = [], 0, [], object()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            waiting.append((batch, keep))
            n = first + len(waiting) - 1
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, "start", "end", "confidence"))
            for row, (k, start, end, confidence) in enumerate(zip(*columns, strict=True)):
                if k != now:
                    active, now = [], k
                gone = step(active, (start, end, confidence, n, row))
                if gone is not None:
                    waiting[gone[3] - first][1][gone[4]] = False
            oldest = min((x[3] for x in active), default=n + 1)
            while waiting and first < min(oldest, n + 1):
                done, mask = waiting.pop(0)
                yield done.filter(pa.array(mask))
                first += 1
        for done, mask in waiting:
            yield done.filter(pa.array(mask))

    return df.repartition(key).sortWithinPartitions(*_span_order(key)).mapInArrow(run, df.schema)


def _surer(x: tuple, y: tuple) -> bool:
    return x[2] is not None and y[2] is not None and x[2] > y[2]


def _meets_last(active: list, x: tuple):
    if active and x[0] is not None and active[0][1] is not None and x[0] < active[0][1]:
        if not _surer(x, active[0]):
            return x
        gone, active[0] = active[0], x
        return gone
    active[:] = [x]
    return None


def _meets_any(active: list, x: tuple):
    if x[0] is None or x[1] is None:
        return None  # overlaps nothing, and nothing overlaps it
    active[:] = [y for y in active if y[1] > x[0]]  # starts only grow: the others are passed
    hit = next((y for y in active if y[0] < x[1]), None)
    if hit is None:
        active.append(x)
        return None
    if not _surer(x, hit):
        return x
    active.remove(hit)
    active.append(x)
    return hit


def resolve_last(df: DataFrame, key: str) -> DataFrame:
    """By start, longest first: an entity that overlaps the last kept one replaces it if it is more confident, else goes."""
    return _fold_spans(df, key, _meets_last)


def resolve_any(df: DataFrame, key: str) -> DataFrame:
    """Likewise, but the first kept one that it overlaps decides; a replacement goes to the end of the kept ones."""
    return _fold_spans(df, key, _meets_any)


def drop_similar(df: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Keep a value if it is less alike than ``least`` (over 0.6) to every value kept before it in its group.

    Alike: 0.4 of the earlier value's words that the later one has, and 0.6 of
    difflib's ratio, on normal forms.  So ``least`` takes a share of common
    words, by which pairs are found in blocks (``matching.word_pairs``), and a
    ratio, which length, letters and common subsequence bound before difflib is
    asked.  Equal forms are one value.  What goes is settled in rounds over the
    pairs (``matching.dropped_in_order``), so a group of any size is many tasks.
    Values without words are like nothing.
    """
    if least <= 0.6:
        raise ValueError("least must be over 0.6: below, values without a common word would be alike")
    path = fresh_folder(df.sparkSession, "alike")
    text = simple(F.col("value"))
    own = matching.in_order(df.withColumn("_text", text).withColumn("_words", word_set(text)), [key], ["seq"], f"{path}/rows")
    firsts = own.where(F.size("_words") > 0).groupBy(key, "_text").agg(F.min("n").alias("n"), F.first("_words").alias("words"))
    firsts = save(firsts, f"{path}/firsts")
    pairs = matching.word_pairs(firsts, firsts, [key], (least - 0.6) / 0.4 - 1e-9).where("n > g")
    texts = firsts.select("n", "_text")
    pairs = pairs.join(texts, "n").join(texts.toDF("g", "_other"), "g")
    edges = pairs.where(_alike(least)("_text", "_other", "score")).select(F.col("g").alias("a"), F.col("n").alias("b"))
    gone = matching.dropped_in_order(edges, path)
    stays = firsts.select("n").join(gone, "n", "left_anti")
    kept = own.join(stays.withColumn("_first", F.lit(True)), "n", "left").where(F.col("_first") | (F.size("_words") == 0))
    return kept.select(*df.columns)


def _alike(least: float):
    @F.arrow_udf("boolean")
    def of(later, earlier, share):
        import pyarrow as pa

        out = []
        for a, b, s in zip(later.to_pylist(), earlier.to_pylist(), share.to_pylist(), strict=True):
            ratio = sequence_at_least(a, b, (least - 0.4 * s) / 0.6 - EPSILON)
            out.append(ratio is not None and 0.4 * s + 0.6 * ratio >= least)
        return pa.array(out, pa.bool_())

    return of


def extractor_statistics(results: DataFrame) -> DataFrame:
    """Per extractor: results, total, mean, least and greatest seconds, tokens and cost."""
    return results.groupBy("extractor").agg(F.count("*").alias("n"), F.sum("seconds").alias("total_s"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"))
