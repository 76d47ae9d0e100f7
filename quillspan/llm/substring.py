"""Repeated passages: seed and extend on winnowed anchors.

A window is ``window`` consecutive words of one document.  Every window picks
its anchor, the run of ``seed_words`` words with the smallest hash in it (the
last one on ties); the choice depends on the window's words only, so equal
windows pick equal anchors at equal offsets.  One row per anchor and document
position goes into the seed join, about one for every 14 words.

Seeds that occur once end there.  Around the others the match is extended both
ways: first over the whole stretch of windows that share the anchor (one hash
of the stretch), which settles the inside of every passage; where stretches
around a seed differ, one document for each distinct stretch is read again and
its windows compared one by one.  What is found are exactly the windows whose
word sequence starts at two places or more; joined, they are the maximal
repeats of at least ``window`` words.  No pairs of occurrences are formed, so
a passage shared by a third of all documents costs a row for each occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch
from quillspan.llm.words import SPACE, U64, blocks, mix, run_hashes

SECOND = 0x5851F42D4C957F2D


def last_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` neighbours, the last one on ties."""
    at, span = np.arange(len(values)), 1

    def lesser(left, right):
        return np.where(values[right] <= values[left], right, left)

    while 2 * span <= width:
        at = lesser(at[:-span], at[span:])
        span *= 2
    more = width - span
    return lesser(at[: len(at) - more], at[more:]) if more else at


def _anchors(window: int, seed_words: int):
    """Batches (id, h, text) -> rows (g, nb, id, h, nw, los): windows lo .. lo + nw - 1 have the anchor g, for each lo of los.

    A stretch that a document holds several times is one row, so text that
    repeats itself costs no more rows than text that doesn't.
    """

    def of(batch):
        out = [[] for _ in range(5)]
        for b in blocks(batch.column(2), SPACE, margin=window - 1):
            n = b.n_words
            if n < window:
                continue
            words = b.word_hashes()
            grams = run_hashes(words, np.arange(n - seed_words + 1), seed_words)
            at = last_argmin(grams, window - seed_words + 1)
            piece = b.piece_of_word()
            i = np.arange(n - window + 1)
            i = i[(piece[i] == piece[i + window - 1]) & (i >= b.own_from[piece[i]]) & (i < b.own_to[piece[i]])]
            if not len(i):
                continue
            a = at[i]
            head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (piece[i][1:] != piece[i][:-1]))))
            lo, size = i[head], np.diff(np.append(head, len(i)))
            stretch = run_hashes(words, lo, size + window - 1, SECOND)
            nb = mix(stretch ^ ((a[head] - lo).astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
            p = piece[lo]
            for k, v in enumerate((grams[a[head]].view(np.int64), nb.view(np.int64), b.rows[p], (lo - b.first[:-1][p] + b.base[p]).astype(np.int32), size.astype(np.int32))):
                out[k].append(v)
        g, nb, row, lo, nw = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        order = np.lexsort((lo, nb, g, row))
        g, nb, row, lo, nw = (x[order] for x in (g, nb, row, lo, nw))
        head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (nb[1:] != nb[:-1])))) if len(row) else np.zeros(0, np.int64)
        take = pa.array(row[head].astype(np.int64))
        los = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(lo.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(g[head], pa.int64()), pa.array(nb[head], pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(nw[head].astype(np.int32)), los], ["g", "nb", "id", "h", "nw", "los"])

    return lambda batches: map(of, batches)


def _fields(col: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's structs begin (one more entry than rows), and fields of all rows' structs; a null array is empty."""
    n = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    fields = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    return np.concatenate(([0], np.cumsum(n, dtype=np.int64))), [x.astype(np.int64) if x.dtype == np.int32 else x for x in (fields[k].to_numpy(zero_copy_only=False) for k in names)]


def _windows(window: int):
    """Batches (text, id, h, spans) -> rows (g, wh, id, h, at, sure): one for each window of the spans."""

    def of(batch):
        off, (begin, size, anchor, twice) = _fields(batch.column(3), "lo", "nw", "g", "sure")
        out = [[] for _ in range(5)]
        for b in blocks(batch.column(0), SPACE, margin=window - 1):
            found = []
            for p, row in enumerate(b.rows.tolist()):
                if off[row] == off[row + 1]:
                    continue
                own = slice(off[row], off[row + 1])
                first = b.base[p] - b.first[p]  # a word's place in the row, less its index in the block
                lo = np.maximum(begin[own], b.own_from[p] + first)
                n = np.maximum(np.minimum(begin[own] + size[own], b.own_to[p] + first) - lo, 0)
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append((np.repeat(anchor[own], n), at - first, np.full(len(at), row), at, np.repeat(twice[own], n)))
            if found:
                for k, v in enumerate(zip(*found, strict=True)):
                    v = np.concatenate(v)
                    out[k].append(run_hashes(b.word_hashes(), v, window, SECOND) if k == 1 else v)
        g, wh, row, at, sure = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        take = pa.array(row.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(wh.view(np.int64), pa.int64()), batch.column(1).take(take), batch.column(2).take(take), pa.array(at.astype(np.int32)), pa.array(sure.astype(bool))], ["g", "wh", "id", "h", "at", "sure"])

    return lambda batches: map(of, batches)


def _cut(window: int):
    """(text, spans) -> (n_words, n_removed, kept): the words of no span, joined by one space."""

    @F.arrow_udf("n_words long, n_removed long, kept string")
    def of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        off, (begin, size_of) = _fields(spans, "lo", "nw")
        n = len(texts)
        total, gone, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [[] for _ in range(n)]
        for b in blocks(texts, SPACE):
            cover = np.zeros(b.n_words + 1, np.int64)
            for p, row in enumerate(b.rows.tolist()):
                lo, hi, back = b.first[p], b.first[p + 1], b.base[p] - b.first[p]
                if off[row] < off[row + 1]:
                    at = begin[off[row] : off[row + 1]] - back
                    a, e = np.maximum(lo, at), np.minimum(hi, at + size_of[off[row] : off[row + 1]] + window - 1)
                    np.add.at(cover, a[a < e], 1)
                    np.subtract.at(cover, e[a < e], 1)
            stay = np.cumsum(cover)[:-1] == 0
            edge = np.zeros(len(b.buf) + 2, np.int8)
            edge[b.starts[stay]] += 1
            np.subtract.at(edge, b.ends[stay] + 1, 1)
            flat = np.where(b.word, b.buf, 32).astype(np.uint8)[np.cumsum(edge[: len(b.buf)]) > 0].tobytes()
            size = np.concatenate(([0], np.cumsum((b.ends - b.starts + 1) * stay)))
            left = np.concatenate(([0], np.cumsum(stay)))
            for p, row in enumerate(b.rows.tolist()):
                lo, hi = b.first[p], b.first[p + 1]
                total[row] += hi - lo
                gone[row] += hi - lo - (left[hi] - left[lo])
                if size[hi] > size[lo]:
                    kept[row].append(flat[size[lo] : size[hi] - 1].decode())
        return pa.StructArray.from_arrays([pa.array(total), pa.array(gone), pa.array([" ".join(k) for k in kept], pa.string())], ["n_words", "n_removed", "kept"])

    return of


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed_words: int = 8) -> DataFrame:
    """(row, n_words, n_removed, kept) for every row of ``docs``.

    ``row`` is a struct of the row's own columns, ``kept`` the words that no
    repeated window covers, joined by one space.  A null text has no words; a
    document of fewer than ``window`` words keeps them all; repeated rows are
    copies of each other, so their windows repeat; rows with null or equal ids
    are told apart by their texts.
    """
    scratch = Scratch(docs.sparkSession, "substring", docs)
    text = F.col("row")[text_col].cast("string").alias("text")  # once in a row, so that a shuffle moves it once
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row")[id_col].cast("long").alias("id"), F.xxhash64(F.col("row")[text_col]).alias("h"))
    seeds = scratch.save(keyed.select("id", "h", text).mapInArrow(_anchors(window, seed_words), "g long, nb long, id long, h long, nw int, los array<int>"))
    often = scratch.save(seeds.groupBy("g").agg(F.sum(F.size("los")).alias("n")).where("n > 1").select("g"))
    # both sides are tables, so that nothing else depends on how this join is dealt and Spark can split a hot anchor
    hits = scratch.save(seeds.join(often, "g"))
    scratch.drop(seeds)
    stretch = scratch.save(hits.groupBy("g", "nb").agg(F.sum(F.size("los")).alias("c"), F.min(F.struct("id", "h", F.col("los")[0].alias("lo"), "nw")).alias("one")))
    inside = hits.join(stretch.where("c > 1").select("g", "nb"), ["g", "nb"]).select("id", "h", "los", "nw")
    mixed = scratch.save(stretch.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"))
    probe = stretch.join(mixed, "g").select("one.id", "one.h", F.struct("one.lo", "one.nw", "g", (F.col("c") > 1).alias("sure")).alias("s"))
    probe = probe.groupBy("id", "h").agg(F.collect_list("s").alias("spans")).withColumnsRenamed({"id": "i", "h": "j"})
    # of repeated rows one is enough: what is compared are distinct stretches
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))
    again = keyed.select("id", "h", text).join(probe, same).select("text", "id", "h", "spans")
    each = scratch.save(again.mapInArrow(_windows(window), "g long, wh long, id long, h long, at int, sure boolean").distinct())
    shared = each.groupBy("g", "wh").agg(F.count("*").alias("n")).where("n > 1").select("g", "wh")
    border = each.where("not sure").join(shared, ["g", "wh"]).groupBy("id", "h").agg(F.collect_set("at").alias("los"))
    spans = inside.union(border.select("id", "h", "los", F.lit(1).alias("nw"))).groupBy("id", "h").agg(F.collect_set(F.struct("los", "nw")).alias("s"))
    spans = spans.select(F.col("id").alias("i"), F.col("h").alias("j"), F.flatten(F.transform("s", lambda x: F.transform(x["los"], lambda lo: F.struct(lo.alias("lo"), x["nw"].alias("nw"))))).alias("spans"))
    return keyed.join(spans, same, "left").select("row", _cut(window)(text, "spans").alias("c")).select("row", "c.*")
