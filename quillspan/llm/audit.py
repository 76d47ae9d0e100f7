"""Filter interaction audit: what every order of some filters would keep, from one count per mask.

A document's mask has a bit for each filter that it fails.  All that the
audit needs of a part are its documents counted by mask, 2^n numbers.  The
subset-zeta transform turns them into f[T], the documents that fail no filter
outside T, so the survivors of a set S of filters are f[all - S].  A step of
an order is then a difference of neighbouring subsets: what filter i removes
after S is f[all - S] - f[all - S - i]; labels are counted likewise.  The data
are read once, whatever the number of orders.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLANKS = r"[\x20\x09-\x0D]+"
#: The bit of the mask for texts that a smaller id has too.
COPY = 4


def text_masks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, digest, mask): the first four bits of a document's mask, by its own text; null texts are empty.

    Bit 0: fewer than 50 words; 1: fewer than 65 in 100 words are distinct; 2:
    over 5 in 100 code points are A-Z; 3: one of ``#$%&*|`` occurs.  ``row`` is
    a struct of the row's own columns, whatever their names.
    """
    base = docs.select(F.struct("*").alias("row"))
    base = base.select("row", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("words", F.filter(F.split("text", BLANKS), lambda w: w != ""))
    n = F.size("words")
    capitals = F.octet_length("text") - F.octet_length(F.regexp_replace("text", "[A-Z]", ""))
    fails = [n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n, 100 * capitals.cast("long") > 5 * F.char_length("text").cast("long"), F.col("text").rlike(r"[#$%&*|]")]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    return base.select("row", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, part: str = "source", id_col: str = "doc_id", marked: dict[str, Column] | None = None) -> DataFrame:
    """(part, mask, n, a count for each of ``marked``), with bit ``COPY`` set for texts that a smaller id has too.

    ``masks``: (row, digest, mask), the mask a function of the text.  A text's
    smallest id is looked for over the whole table.  Rows are counted by text,
    part and labels before a text's rows meet, so that a group of copies of any
    size is a few rows by then, one for each of its parts and labels.  A
    document has a label if any of its rows in ``labels`` says so (``marked``:
    conditions on them); null ids have none, fail by no copy and make no other
    fail; rows that repeat a text's smallest id don't fail.  A null part is
    the empty string; empty tables give no rows.
    """
    marked = marked or {}
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(name) for name, c in marked.items()])
    own = masks.select(F.col("row")[id_col].cast("long").alias("id"), F.coalesce(F.col("row")[part].cast("string"), F.lit("")).alias("part"), "digest", "mask")
    if marked:
        own = own.join(known, "id", "left").select("id", "part", "digest", "mask", *[F.coalesce(name, F.lit(False)).alias(name) for name in marked])
    keys = ["digest", "part", "mask", *marked]
    each = own.groupBy("id", *keys).agg(F.count("*").alias("n"))  # dealt by id already
    named, loose = F.when(F.col("id").isNotNull(), F.struct("id", "n")), F.when(F.col("id").isNull(), F.col("n"))
    texts = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(named).alias("low"), F.coalesce(F.sum(loose), F.lit(0)).alias("loose"))
    texts = texts.withColumn("least", F.min("low.id").over(Window.partitionBy("digest")))
    stays = F.when(F.col("low.id") == F.col("least"), F.col("low.n")).otherwise(F.lit(0)) + F.col("loose")
    both = F.array(F.struct(F.col("mask").alias("m"), stays.alias("k")), F.struct((F.col("mask") + (1 << COPY)).alias("m"), (F.col("n") - stays).alias("k")))
    split = texts.select("part", *marked, F.explode(both).alias("s")).where("s.k > 0")
    return split.groupBy("part", F.col("s.m").alias("mask")).agg(F.sum("s.k").alias("n"), *[F.sum(F.when(F.col(name), F.col("s.k")).otherwise(F.lit(0))).alias(name) for name in marked])


def _dense(counts: str, full: int) -> Column:
    """A map of counts by mask as an array over all masks."""
    return F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.try_element_at(F.col(counts), m), F.lit(0)).cast("long"))


def zeta_step(counts: str, k: int) -> Column:
    """One filter's step of the transform: each subset with bit k gains the count of the same subset without it."""
    bit = 1 << k
    return F.transform(counts, lambda x, t: F.when(t.bitwiseAND(F.lit(bit)) != 0, x + F.get(F.col(counts), t - bit)).otherwise(x))


def order_steps(names: str) -> Column:
    """An array of (filter_order, step, k, bit, left): every step of every order, k and bit its filter and left the filters not yet applied, as a mask."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        left = (1 << len(names)) - 1
        for step, k in enumerate(order):
            rows.append({"filter_order": "".join(names[i] for i in order), "step": step + 1, "k": k, "bit": 1 << k, "left": left})
            left ^= 1 << k
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, k: int, bit: int, left: int>>")


def audit(counts: DataFrame, names: str = "ABCDE", marked: tuple[str, ...] = ()) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter keeps and removes there.

    ``counts``: (part, mask, n, counts of ``marked``), a row for each mask that
    occurs in a part.  ``redundant``: documents that fail the step's filter and
    were removed before; ``unique_fails``: that fail no other filter;
    ``<label>_lost``: labelled documents that the step removes; ``shapley``:
    what the filter removes, summed over all orders.  A part without documents
    has no rows.
    """
    n, full = len(names), (1 << len(names)) - 1
    values = ["n", *marked]
    # a part has at most 2^n rows
    per = counts.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", v))).alias(v) for v in values])
    f = per.select("part", *[_dense(v, full).alias(v) for v in values])
    f = f.withColumn("alone", F.array(*[F.get("n", F.lit(1 << k)) for k in range(n)]))
    for k in range(n):
        f = f.select("part", "alone", *[zeta_step(v, k).alias(v) for v in values])
    # filter k comes right after the set s in |s|! (n - 1 - |s|)! of the orders
    weight = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) if s < full else 0 for s in range(full + 1)]
    gains = [sum(((F.get("n", F.lit(full ^ s)) - F.get("n", F.lit(full ^ s ^ 1 << k))) * weight[s] for s in range(full + 1) if not s >> k & 1), F.lit(0)) for k in range(n)]
    steps = f.withColumn("gains", F.array(*gains)).withColumn("s", F.explode(order_steps(names))).select("*", "s.*")
    after = F.col("left") - F.col("bit")
    lost = {v: F.get(v, F.col("left")) - F.get(v, after) for v in values}
    failing = F.get("n", F.lit(full)) - F.get("n", full - F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", F.get("n", after).alias("kept"), lost["n"].alias("removed"), (failing - lost["n"]).alias("redundant"),
        F.get("alone", F.col("k")).alias("unique_fails"), *[lost[v].alias(f"{v}_lost") for v in marked], F.get("gains", F.col("k")).alias("shapley"),
    )
