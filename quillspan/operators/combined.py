"""Each prediction's best gold by the combined score, many pairs at once.

A document's values of a type are compared in cells of about ``BLOCK``
predictions and ``BLOCK`` golds, so that a large group is dealt over many
tasks.  Within a task the pairs of many cells go through falling bounds in
NumPy: shared words and lengths, letters, and the longest common subsequence.
Only what these leave goes to difflib, best bound first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillspan.functions.similarity import EPSILON, RECALL
from quillspan.functions.text import simple
from quillspan.sources.shared import fresh_folder, save, small_batches

#: Values of a side that meet in one cell, and pairs that are held at once.
BLOCK, PAIRS = 512, 1 << 19
#: 64-bit words that one step of the common subsequences goes through, and those of a table of letters.
STEP, TABLE = 1 << 14, 1 << 21
#: Letters are counted in so many classes.
LETTERS = 32


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def common_subsequence(x: list[str], y: list[str], p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair (x[p], y[g]), by bit-parallel rows as ``similarity.indel``."""
    (xs, x_off), (ys, y_off) = _flat(x), _flat(y)
    letters, code = np.unique(np.concatenate((xs, ys)), return_inverse=True)
    xs, ys, k = code[: len(xs)], code[len(xs) :], len(letters)
    x_len, y_len = np.diff(x_off), np.diff(y_off)
    out, width = np.zeros(len(p), np.int64), -(-x_len // 64)
    order = np.lexsort((p, width[p]))
    order = order[np.searchsorted(width[p][order], 1) :]
    turn = np.concatenate(([0], np.cumsum(np.diff(p[order]) != 0)))
    same = np.searchsorted(width[p][order], np.arange(width.max(initial=0) + 2))
    lo = 0
    while lo < len(order):
        w = int(width[p[order[lo]]])
        hi = min(lo + max(1, STEP // w), int(same[w + 1]), int(np.searchsorted(turn, turn[lo] + max(1, TABLE // (k * w)))))
        own = order[lo:hi]
        own = own[np.argsort(-y_len[g[own]], kind="stable")]
        used, local = np.unique(p[own], return_inverse=True)
        size = x_len[used]
        place = _ranges(np.zeros(len(used), np.int64), size)
        table = np.zeros((w, len(used) * k), np.uint64)
        np.bitwise_or.at(table, (place // 64, np.repeat(np.arange(len(used)) * k, size) + xs[_ranges(x_off[used], size)]), np.left_shift(np.uint64(1), (place % 64).astype(np.uint64)))
        rows = [np.full(len(own), ~np.uint64(0)) for _ in range(w)]
        base, start, lengths = local * k, y_off[g[own]], y_len[g[own]]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]))
        for j, n in enumerate(active.tolist()):
            at, carry = base[:n] + ys[start[:n] + j], None
            for i in range(w):
                v = rows[i][:n]
                hit = v & table[i].take(at)
                s = v + hit
                if w > 1:
                    over = s < v
                    if i:
                        s += carry
                        over |= s < carry
                    carry = over
                np.bitwise_or(s, v ^ hit, out=v)
        out[own] = 64 * w - sum(np.bitwise_count(r).astype(np.int64) for r in rows)
        lo = hi
    return out


def _shared_words(x: list[str], y: list[str], x_row: np.ndarray, y_row: np.ndarray, first: np.ndarray, y_place: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words that each pair shares, distinct words of each y); pair ``first[i] + y_place[j]`` is (i, j) of a row."""
    known: dict[str, int] = {}
    number = lambda t: [known.setdefault(w, len(known)) for w in set(t.split(" ")) if w]
    own = [[number(t) for t in side] for side in (x, y)]
    (xo, xw), (yo, yw) = ((np.repeat(np.arange(len(s)), [len(t) for t in s]), np.array([w for t in s for w in t], np.int64)) for s in own)
    xk, yk = x_row[xo] * len(known) + xw, y_row[yo] * len(known) + yw
    order = np.argsort(xk, kind="stable")
    begin = np.searchsorted(xk[order], yk)
    size = np.searchsorted(xk[order], yk, "right") - begin
    met = first[xo[order[_ranges(begin, size)]]] + np.repeat(y_place[yo], size)
    return np.bincount(met, minlength=pairs), np.array([len(t) for t in own[1]], np.int64)


def _counted(texts: list[str]) -> np.ndarray:
    """How often each class of letters is in each text."""
    flat, off = _flat(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(off))
    return np.bincount(owner * LETTERS + flat % LETTERS, minlength=len(texts) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


def _share(common: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, 2 * common / np.maximum(n, 1), 1.0)


def sequence(x: str, y: str) -> float:
    """difflib's ratio.  A value in the other is one block, as long as nothing counts as junk (``y`` under 200 characters)."""
    if len(y) < 200 and (x in y or y in x):
        return 2.0 * min(len(x), len(y)) / (len(x) + len(y)) if x or y else 1.0
    return SequenceMatcher(None, x, y).ratio()


def best_of(x: list[str], y: list[str], x_row: np.ndarray, y_row: np.ndarray, order: np.ndarray, least: float, package: bool) -> tuple[list, list, list]:
    """(i, j, score): for each value x[i] the best y[j] of its row, ties by ``order``; none below ``least``."""
    y_size = np.bincount(y_row, minlength=int(x_row.max(initial=-1)) + 1)
    y_begin = np.cumsum(y_size) - y_size
    each = y_size[x_row]
    first, p, g = np.cumsum(each) - each, np.repeat(np.arange(len(x)), each), _ranges(y_begin[x_row], each)
    common, words = _shared_words(x, y, x_row, y_row, first, np.arange(len(y)) - y_begin[y_row], len(p))
    recall = common / np.maximum(words[g], 1)
    n, m = (np.array([len(t) for t in s], np.int64) for s in (x, y))
    bound = 0.4 * recall + 0.6 * _share(np.minimum(n[p], m[g]), n[p] + m[g])

    def scored(i, j, recall, edit):
        ratio = sequence(x[i], y[j])
        return 0.4 * recall + 0.3 * (edit if package else ratio) + 0.3 * ratio

    floor = np.full(len(x), least)
    some = np.flatnonzero(each)
    if len(some):
        # a value in the other has the ratio that their lengths give, so its score is the bound
        top = np.flatnonzero(bound >= np.repeat(np.maximum.reduceat(bound, first[some]), each[some]))
        top = top[np.unique(p[top], return_index=True)[1]]
        for k, i, j in zip(top.tolist(), p[top].tolist(), g[top].tolist(), strict=True):
            if len(y[j]) < 200 and (x[i] in y[j] or y[j] in x[i]):
                floor[i] = max(least, bound[k])

    def left(bound, *columns):
        ok = bound >= floor[p] - EPSILON
        return [c[ok] for c in columns]

    p, g, recall = left(bound, p, g, recall)
    a, b = _counted(x), _counted(y)
    letters = np.concatenate([np.zeros(0, np.int64), *(np.minimum(a[p[k : k + STEP]], b[g[k : k + STEP]]).sum(1) for k in range(0, len(p), STEP))])
    p, g, recall = left(0.4 * recall + 0.6 * _share(letters, n[p] + m[g]), p, g, recall)
    edit = _share(common_subsequence(x, y, p, g), n[p] + m[g])
    bound = 0.4 * recall + 0.6 * edit
    p, g, recall, edit, bound = left(bound, p, g, recall, edit, bound)
    by = np.lexsort((order[g], -bound, p))
    found: dict[int, tuple[float, int]] = {}
    for i, j, r, e, top in zip(*(c[by].tolist() for c in (p, g, recall, edit, bound)), strict=True):
        best = found.get(i)
        if best is not None and top < best[0] - EPSILON:
            continue
        score = scored(i, j, r, e)
        if score >= least and (best is None or score > best[0] or (score == best[0] and order[j] < order[best[1]])):
            found[i] = score, j
    return list(found), [j for _, j in found.values()], [s for s, _ in found.values()]


def _compare(schema, least: float, package: bool):
    """Batches of cells -> the best gold of each of their predictions."""
    keys = schema.names[:-4]

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        asks, golds = batch["asks"], batch["golds"]
        rows = [np.repeat(np.arange(len(batch)), c.value_lengths().to_numpy(zero_copy_only=False)) for c in (asks, golds)]
        own, flat = asks.flatten(), golds.flatten()
        i, j, score = best_of(own.to_pylist(), flat.field("text").to_pylist(), *rows, flat.field("order").to_numpy(), least, package)
        j = pa.array(j, pa.int64())
        at = pa.array(rows[0][np.array(i, np.int64)], pa.int64())
        got = [*(batch[k].take(at) for k in keys), own.take(pa.array(i, pa.int64())), flat.field("order").take(j), flat.field("gold").take(j), pa.array(score, pa.float64())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(got, schema, strict=True)], schema=schema)

    def run(batches):
        for batch in batches:
            pairs = np.cumsum(batch["asks"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) * batch["golds"].value_lengths().to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + PAIRS, "right")))
                yield part(batch.slice(lo, hi - lo))
                lo = hi

    return run


def best_combined(pred: DataFrame, gold: DataFrame, least: float, package: bool) -> DataFrame:
    """(doc_id, type, text, gold, score): the best gold of each distinct ``simple`` text of the predictions, the first of ties; none below ``least`` > 0.

    Equal texts with a word have the highest score there is and are found by
    grouping; the other predictions meet the golds in cells.
    """
    spark, keys = pred.sparkSession, ["doc_id", "type"]
    small_batches(spark)
    text, value = simple(F.col("value")).alias("text"), F.struct(F.col("seq").cast("long").alias("order"), F.col("value").alias("gold")).alias("g")
    both = pred.select(*keys, text, F.lit(True).alias("asked")).unionByName(gold.select(*keys, text, F.lit(False).alias("asked"), value), allowMissingColumns=True)
    values = both.dropna(subset=[*keys, "text"]).groupBy(*keys, "text").agg(F.max("asked").alias("asked"), F.min("g").alias("g"))
    values = save(values.withColumn("same", F.col("asked") & F.col("g").isNotNull() & (F.size(RECALL.prepare(F.col("text"))) > 0)), f"{fresh_folder(spark, 'matching')}/values")
    asks, golds = F.col("asked") & ~F.col("same"), F.col("g").isNotNull()
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
    sizes = values.groupBy(*keys).agg(blocks(asks).alias("bp"), blocks(golds).alias("bg")).where("bp > 0 and bg > 0")
    dealt = values.join(sizes, keys)

    def side(own, n, cell, column, other, met):
        packed = dealt.where(own).groupBy(*keys, F.pmod(F.xxhash64("text"), F.col(n)).cast("int").alias(cell), other).agg(F.collect_list(column).alias(met))
        return packed.withColumn("cp" if cell == "cg" else "cg", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(other)

    p = side(asks, "bp", "cp", F.col("text"), "bg", "asks")
    g = side(golds, "bg", "cg", F.struct("g.order", "text", "g.gold"), "bp", "golds")
    by = [*keys, "cp", "cg"]
    # dealt evenly and by number: few bytes are much work, and by bytes they would be put in few tasks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cells = p.join(g, by).repartition(parts)
    schema = values.select(*keys, "text", "g.order", "g.gold", F.lit(0.0).alias("score")).schema
    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    met = cells.mapInArrow(_compare(arrow, least, package), schema)
    best = met.groupBy(*keys, "text").agg(F.max_by(F.struct("gold", "score"), F.struct("score", -F.col("order"))).alias("m")).select(*keys, "text", "m.*")
    same = values.where("same").select(*keys, "text", "g.gold", F.lit(0.4 + 0.3 + 0.3).alias("score")).where(F.col("score") >= least)
    return best.unionByName(same)
