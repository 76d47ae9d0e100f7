"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Fingerprints are 64-bit SimHashes of word shingles.  To find all pairs of
fingerprints within ``radius`` bits, every bit position gets a vector over
GF(2) of ``radius + 1`` bits; each non-zero vector v defines one table, whose
key keeps the bits whose vector isn't orthogonal to v.  The at most ``radius``
positions where two such fingerprints differ span a proper subspace, so some v
is orthogonal to all of them, that table leaves all of them out of its key, and
the pair has equal keys there: every
pair within the radius collides for certain (2^(radius+1) - 1 tables).

Equal fingerprints are one node from the start, so groups of exact copies cost
nothing further.  Within a bucket, fingerprints are compared in blocks and
only the links that join two groups are kept, not all pairs; buckets over
``BUCKET`` fingerprints are cut again by a second covering of their members,
which leaves at most 2^16 distinct fingerprints in each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import FOREST_LIMIT, Forest, components
from quillspan.llm.scratch import Scratch
from quillspan.llm.words import SPACE, blocks
from quillspan.llm.xxh64 import xxh64_runs

#: Buckets of more fingerprints than this are cut by a second covering.
BUCKET = 8192


def shingle_runs(col, shingle: int, seed: int):
    """(rows, heads, h): for some rows of an Arrow text column, where each row's shingle hashes begin in ``h``; a long text comes in several parts."""
    for b in blocks(col, SPACE, lower=True, margin=shingle - 1):
        if not b.n_words:
            continue
        size = b.ends - b.starts
        keep = b.word.copy()
        keep[b.ends] = True  # one separator after each word
        flat = np.where(b.word, b.buf, 32).astype(np.uint8)[keep]
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        piece = b.piece_of_word()
        last = b.first[1:][piece] - 1
        i = np.arange(b.n_words)
        valid = i <= np.maximum(b.first[:-1][piece], last - shingle + 1)
        valid &= (i >= b.own_from[piece]) & (i < b.own_to[piece])
        if b.base.any():  # a later piece: a shingle of fewer words is its row's end only
            valid &= i + shingle - 1 <= last
        i = i[valid]
        if not len(i):
            continue
        end = np.minimum(i + shingle - 1, last[valid])
        h = xxh64_runs(flat, begin[i], begin[end] + size[end] - begin[i], seed)
        piece = piece[valid]
        heads = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        yield b.rows[piece[heads]], heads, h


def count_bits(ones: np.ndarray, total: np.ndarray, rows: np.ndarray, heads: np.ndarray, h: np.ndarray) -> None:
    bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    np.add.at(ones, rows, np.add.reduceat(bits, heads, axis=0, dtype=np.int64))
    np.add.at(total, rows, np.diff(np.append(heads, len(h))))


def majority(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.packbits(2 * ones > total[:, None], axis=1).view(np.uint64).byteswap().ravel()


def fingerprint_texts(col, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text of an Arrow column (uint64)."""
    ones = np.zeros((len(col), 64), np.int64)
    total = np.zeros(len(col), np.int64)
    for rows, heads, h in shingle_runs(col, shingle, seed):
        count_bits(ones, total, rows, heads, h)
    return majority(ones, total)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): one row per row of ``docs``, fp the fingerprint's bits as a signed long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprint_texts(texts, shingle, seed).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("id"), of(F.col(text_col).cast("string")).alias("fp"))


def masks(radius: int, seed: int = 0) -> list[int]:
    """The bit masks of the covering, as signed longs."""
    r = radius + 1
    # position i has the vector (i mod (2^r - 1)) + 1: all non-zero vectors, equally often
    vector = [(i * (2 * seed + 1) + seed) % ((1 << r) - 1) + 1 for i in range(64)]
    out = []
    for v in range(1, 1 << r):
        m = sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _linker(radius: int, limit: int | None):
    """Reads rows (table, key, fp) sorted by all three; yields links, and the rows of too large buckets."""

    def run(batches):
        forest, over = Forest(), []
        rest = [np.zeros(0, np.int64)] * 3

        def flush():
            nonlocal forest
            a = np.array(forest.links, np.int64).reshape(-1, 2)
            b = np.concatenate(over, axis=0) if over else np.zeros((0, 2), np.int64)
            both = np.concatenate((a, b))
            kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(b)])
            forest.links.clear()
            over.clear()
            if len(forest.parent) > FOREST_LIMIT:
                forest = Forest()
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(both[:, 0]), pa.array(both[:, 1])], ["kind", "a", "b"])

        def bucket(t, fps):
            fps = np.unique(fps)
            if limit and len(fps) > limit:
                over.append(np.stack((np.full(len(fps), t, np.int64), fps), axis=1))
                return
            left = fps.view(np.uint64)
            while len(left):
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    x = queue.pop()
                    near = np.bitwise_count(left ^ x) <= radius
                    if near.any():
                        found = left[near]
                        left = left[~near]
                        queue.extend(found)
                        a = int(x.view(np.int64))
                        for y in found.view(np.int64).tolist():
                            forest.join(a, y)

        def runs(t, k, fp):
            head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]), [True])))
            size = np.diff(head)
            for lo, n in zip(head[:-1][size == 2].tolist(), size[size == 2].tolist(), strict=True):
                if (int(fp[lo]) ^ int(fp[lo + 1])) & 0xFFFFFFFFFFFFFFFF and ((int(fp[lo]) ^ int(fp[lo + 1])) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius:
                    forest.join(int(fp[lo]), int(fp[lo + 1]))
            for lo, n in zip(head[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                bucket(int(t[lo]), fp[lo : lo + n])

        for batch in batches:
            t, k, fp = (np.concatenate((r, c.to_numpy(zero_copy_only=False).astype(np.int64))) for r, c in zip(rest, batch.columns, strict=True))
            if not len(t):
                continue
            tail = np.flatnonzero((t != t[-1]) | (k != k[-1]))  # the last bucket may go on
            cut = int(tail[-1]) + 1 if len(tail) else 0
            if cut:
                runs(t[:cut], k[:cut], fp[:cut])
            rest = [t[cut:], k[cut:], fp[cut:]]
            if len(forest.links) > 50_000 or sum(map(len, over)) > 50_000:
                yield flush()
        if len(rest[0]):
            runs(*rest)
        yield flush()

    return run


def _by_table(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp")


def links(fps: DataFrame, scratch: Scratch, radius: int = 4, most: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that differ in at most ``radius`` bits.

    Not all pairs: as many links as hold the connected groups together.
    ``most``: a bound on the fingerprints, if it is known.
    """
    first, second = masks(radius), masks(radius, seed=5)
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(first)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    found = scratch.save(_by_table(rows, "t", "k").mapInArrow(_linker(radius, BUCKET), "kind int, a long, b long"), most)
    over = found.where("kind = 1").select(F.col("a").alias("t"), F.col("b").alias("fp"))
    mask: Column = F.element_at(F.array(*[F.lit(m).cast("long") for m in first]), (F.col("t") + 1).cast("int"))
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("u"), F.col("fp").bitwiseAND(mask.bitwiseOR(F.lit(m).cast("long"))).alias("k")) for i, m in enumerate(second)])
    deep = over.select("t", "fp", F.explode(tables).alias("x")).select((F.col("t") * 64 + F.col("x.u")).alias("t"), "x.k", "fp")
    deep = _by_table(deep, "t", "k").mapInArrow(_linker(radius, None), "kind int, a long, b long")
    return found.where("kind = 0").union(deep).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, the row's own included.

    Defined results: a null or wordless text has fingerprint zero and is linked
    like any other; rows with a null id keep their fingerprint and count for
    links, and a group of such rows only has a null component; repeated ids
    give repeated rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash", docs)
    fp = scratch.save(fingerprints(docs, id_col, text_col, shingle, seed))
    node = scratch.save(fp.groupBy("fp").agg(F.min("id").alias("low")))
    root = components(links(node.select("fp"), scratch, radius), scratch).withColumnsRenamed({"node": "fp"})
    linked = node.join(root, "fp")
    low = linked.groupBy("root").agg(F.min("low").alias("component"))
    reach = linked.join(low, "root").select("fp", "component")
    # saved, so that Spark can split the join of a fingerprint that very many rows have
    alone = scratch.save(node.join(reach, "fp", "left").select("fp", F.coalesce("component", "low").alias("component")))
    return fp.join(alone, "fp").select("id", "fp", "component")
