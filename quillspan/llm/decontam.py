"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by size: class u holds items of up to u distinct
``shingle``-word shingles (u a power of two).  An item's sketch is its bottom-k
MinHash, the k shingles with the smallest hashes, with one k for the class:
k = u - ceil(t * u) + 1.  A document that contains a share of t or more of the
item's shingles misses fewer than k of them, so it holds at least one of the
sketch: short items are found inside documents of any length, none is missed,
and no signature of the document is needed whose size would have to grow with
it.  Documents that hold a sketch value are verified by exact containment of
the item's shingles, byte for byte.

The items are a stated query set.  They are gathered in blocks of about
``block_bytes`` bytes of text; documents pass one block after the other, and
one block's index at a time is sent to the executors, so what is broadcast
stays the same size however many items there are.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch, bounded_batches
from quillspan.llm.words import LOWER, PUNCT, blocks, run_hashes

SHINGLE, SHARE, BLOCK_BYTES = 5, 0.8, 4 << 20


def shingles(text: str | bytes | None, k: int = SHINGLE) -> list[bytes]:
    """All word shingles of a text: ASCII letters lowered, words cut at ASCII white space and signs, joined by one space."""
    raw = np.frombuffer((text or b"") if isinstance(text, bytes) else (text or "").encode(), np.uint8)
    words = np.where(PUNCT[raw], 32, LOWER[raw]).astype(np.uint8).tobytes().split()
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


class ItemIndex:
    """Sketches and shingles of one block of test items."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, share: float = SHARE):
        self.k, self.share = k, share
        self.ids = [i for i, _ in items]
        self.sizes = [min(k, len(shingles(t, 1))) for _, t in items]
        self.sets = [frozenset(shingles(t, m)) if m else frozenset() for (_, t), m in zip(items, self.sizes, strict=True)]
        self.parts = {m: self._part(items, m) for m in sorted({k, *self.sizes} - {0})}

    def _part(self, items: list[tuple[int, str]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sketch values, ascending, their items, and a sieve of the values, of the items whose shingles have ``k`` words."""
        keys, owners, share = [], [], self.share
        for n, (_, text) in enumerate(items):
            h = np.unique(_hashes(pa.array([text or ""], pa.string()), k)[1]) if self.sizes[n] == k else ()
            if len(h):
                u = 1 << (len(h) - 1).bit_length()
                own = h[: u - math.ceil(share * u) + 1]  # the smallest hashes
                keys.append(own)
                owners.append(np.full(len(own), n))
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        sieve = np.zeros(1 << 20, bool)
        sieve[(key & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return key[order], owner[order], sieve

    def search(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text the items it contains: (item id, shingles found, shingles of the item)."""
        wanted: dict[int, set[int]] = {}
        for k, (key, owner, sieve) in self.parts.items():
            row, h = _hashes(texts, k, sieve)
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                wanted.setdefault(int(row[i]), set()).update(owner[lo[i] : hi[i]].tolist())
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        for r, items in wanted.items():
            text = texts[r].as_py()
            own = {m: set(shingles(text, m)) for m in {self.sizes[n] for n in items}}
            for n in sorted(items):
                found = len(self.sets[n] & own[self.sizes[n]])
                if found >= self.share * len(self.sets[n]):
                    out[r].append((self.ids[n], found, len(self.sets[n])))
        return out


def _hashes(texts, k: int, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of each text, those only that pass the sieve."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in blocks(texts, PUNCT, lower=True, margin=k - 1):
        n = b.n_words - k + 1
        if n < 1:
            continue
        h = run_hashes(b.word_hashes(), np.arange(n), k)
        i = np.flatnonzero(sieve[(h & np.uint64(0xFFFFF)).astype(np.int64)]) if sieve is not None else np.arange(n)
        piece = np.searchsorted(b.first, i, "right") - 1
        i = i[i + k <= b.first[1:][piece]]
        rows.append(b.rows[np.searchsorted(b.first, i, "right") - 1])
        found.append(h[i])
    return np.concatenate(rows), np.concatenate(found)


def _blocks_of(items: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` bytes, as lists; hashing spreads them evenly.  At least one block, empty or not."""
    items = items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    parts = max(1, -(-size // block_bytes))
    for n in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == n)
        yield n == parts - 1, sorted(((r[0], r[1]) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    row = docs.select(F.struct("*").alias("row"))
    return row.select("row", F.col("row")[text_col].cast("string").alias("t"))


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, hits, n_items): each row of ``docs`` with the items of whose distinct shingles it contains ``share`` or more.

    Null texts are empty and long ones are searched whole.  An item of fewer
    than ``shingle`` words has its whole sequence of words as one shingle; one
    without words is never found; items with equal ids are separate items; a
    null item id stays null.  Repeated rows of ``docs`` are marked alike, an
    empty table gives an empty one and ``row`` is a struct, so columns of any
    name pass through.  With several blocks of items the rows are written to
    the shared folder after each block but the last.
    """
    bounded_batches(docs.sparkSession)
    context, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontam", docs)
    now = docs.select(F.struct("*").alias("row")).withColumn("hits", F.array().cast(HITS))
    for last, block in _blocks_of(items, item_id, item_text, block_bytes):
        index = context.broadcast(ItemIndex(block, shingle, share))
        found = _searcher(index)(F.col("row")[text_col].cast("string"))
        now = now.select("row", F.concat("hits", found).alias("hits"))
        if not last:
            now = scratch.save(now)
            index.destroy()
    return now.withColumn("n_items", F.size("hits"))


def contained_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, item_id, found, size): a row for each document and item that ``mark`` finds in it; only those are written between blocks."""
    bounded_batches(docs.sparkSession)
    context, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontam", docs)
    parts = []
    for last, block in _blocks_of(items, item_id, item_text, block_bytes):
        index = context.broadcast(ItemIndex(block, shingle, share))
        found = _keyed(docs, text_col).select("row", F.explode(_searcher(index)(F.col("t"))).alias("x")).select("row", "x.*")
        if not last:
            found = scratch.save(found)
            index.destroy()
        parts.append(found)
    return functools.reduce(DataFrame.union, parts)


HITS = "array<struct<item_id:long,found:long,size:long>>"


def _searcher(shared):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("found", pa.int64()), ("size", pa.int64())]))

    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        got = [[{"item_id": i, "found": f, "size": s} for i, f, s in hits] for hits in shared.value.search(texts)]
        return pa.array(got, kind)

    return search
