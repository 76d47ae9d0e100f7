"""Groups of documents whose word shingles have a Jaccard similarity of ``similarity`` or more.

SimHash leads: texts with equal shingle sets are one node, and nodes whose
fingerprints differ in few bits are linked by the covering of ``simhash``.  At
a similarity of 0.8 two fingerprints of 64 bits differ in about ten, which no
covering of a practical number of tables reaches, and some pairs within four
bits are below 0.8.  So every link is decided by the exact similarity of the
whole texts, and an exact join finds what the covering can't.

That join is by prefixes.  Each text's distinct shingles are put in one common
order, those that many texts have last.  Let a text of n shingles have the
prefix of its first n - ceil(t n) + 1.  Two texts that reach similarity t share
at least ``alpha`` shingles, and of those the first in the order lie in both
prefixes, as many as ``_shared_at_least`` says.  Texts that have too few such
shared shingles with any other are left alone; of the rest each node is compared,
in a few rounds, with one pivot of the prefixes it shares, the one it shares
most with, which joins large groups at a cost that follows their size.  All
pairs that are left, nodes of different groups that share enough of their
prefixes, are then compared without exception, so no pair is lost (up to
collisions of 64 bits of hash).  The order is estimated from a sample; it bears
on the cost only, any order gives the same groups.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm import simhash
from quillspan.llm.components import components
from quillspan.llm.scratch import Scratch, more_partitions
from quillspan.llm.simhash import shingle_runs
from quillspan.llm.words import mix

#: Rounds of pivots; what they leave is left to the exact join.
ROUNDS = 3
#: Texts in the sample for the order of shingles.
SAMPLE = 20_000
#: Shingles of which the order knows how often they occur, the most frequent ones; the others count as rare.
KNOWN = 1 << 20
#: Nodes of a shingle from which it counts as hot and isn't paired off in advance; nodes in a block of the exact join.
HOT, BLOCK = 64, 4096
#: Times as many shuffle partitions for the rows of all prefixes, of which a text has one for every five words.
WIDE = 4


def _distinct(col, shingle: int, seed: int = 42, ones: np.ndarray | None = None, total: np.ndarray | None = None):
    """(row, the sorted distinct shingle hashes) of each text that has words; a long text's parts come one after the other.

    ``ones`` and ``total``, if given, gather the bit counts of the fingerprints.
    """
    at, some = -1, []
    for rows, heads, h in shingle_runs(col, shingle, seed):
        if ones is not None:
            simhash.count_bits(ones, total, rows, heads, h)
        for row, lo, hi in zip(rows.tolist(), heads, np.append(heads[1:], len(h)), strict=True):
            if row != at:
                if some:
                    yield at, np.unique(np.concatenate(some))
                at, some = row, []
            some.append(h[lo:hi])
    if some:
        yield at, np.unique(np.concatenate(some))


def _lists(parts: list, n: int) -> pa.Array:
    """An Arrow array of lists from (row, hashes) pairs with ascending rows; other rows have empty lists."""
    size = np.zeros(n + 1, np.int64)
    for row, h in parts:
        size[row + 1] = len(h)
    flat = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in parts)])
    return pa.ListArray.from_arrays(np.cumsum(size).astype(np.int32), pa.array(flat.view(np.int64)))


def _least(n, similarity: float):
    """The shingles that a text of ``n`` must share."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``KNOWN`` most frequent shingles that three or more sampled texts have, ascending, and about how many of all texts have each."""
    every = max(1, texts.count() // SAMPLE)

    @F.arrow_udf("array<long>")
    def of(col: pa.Array) -> pa.Array:
        return _lists(list(_distinct(col, shingle)), len(col))

    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.explode(of("text")).alias("h"))
    got = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(KNOWN).toArrow()
    h = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got.column("count").to_numpy().astype(np.int64)[order] * every


def _sketched(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(id, s1, s2, fp, size, first) of each row (id, text).

    Two hashes of the set of shingles, the fingerprint, the set's size and its
    first shingles in the common order; a text without words has set (0, 0).
    """
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle))

    def often(h: np.ndarray) -> np.ndarray:
        known, count = common.value
        if not len(known):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[i] == h, count[i], 0)

    @F.arrow_udf("s1 long, s2 long, fp long, size int, first array<long>")
    def of(col: pa.Array) -> pa.Array:
        n = len(col)
        sets, size, parts = np.zeros((n, 2), np.uint64), np.zeros(n, np.int32), []
        ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
        with np.errstate(over="ignore"):
            for row, h in _distinct(col, shingle, 42, ones, total):
                sets[row] = np.sum(mix(h), dtype=np.uint64), np.sum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
                size[row] = len(h)
                parts.append((row, h[np.lexsort((h, often(h)))[: len(h) - int(_least(len(h), similarity)) + 1]]))
        fp = simhash.majority(ones, total).view(np.int64)
        return pa.StructArray.from_arrays([*(pa.array(sets[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(fp), pa.array(size), _lists(parts, n)], ["s1", "s2", "fp", "size", "first"])

    return texts.select("id", of("text").alias("x")).select("id", "x.*")


def _ceil(x: Column) -> Column:
    return F.ceil(x - 1e-9).cast("int")


def _alpha(na: Column, nb: Column, t: float) -> Column:
    """The shingles that two similar texts of these sizes share."""
    return _ceil(t / (1 + t) * (na + nb))


def _shared_at_least(na: Column, nb: Column, t: float) -> Column:
    """The shingles in both prefixes of two similar texts; more than any text has if the sizes rule a pair out.

    The k-th shared shingle has at most k - 1 shared ones and n - alpha others
    before it, so it is among the first n - ceil(t n) + 1 if k is at most
    alpha - ceil(t n) + 1.
    """
    k = _alpha(na, nb, t) + 1 - _ceil(t * F.greatest(na, nb))
    return F.when(F.least(na, nb) >= _ceil(t * F.greatest(na, nb)), k).otherwise(F.lit(2**31 - 1))


def _close(a: tuple, b: tuple, similarity: float) -> np.ndarray:
    """Whether two rows (id, root, place, size) of different groups that share a shingle may be similar, if it is their first one in common."""
    (_, ra, pa_, na), (_, rb, pb, nb) = a, b
    return (ra != rb) & (np.minimum(na - pa_, nb - pb) >= _least((na + nb) / (1 + similarity), similarity))


def _pairs(similarity: float):
    """Reads rows (key, id, root, place, size) sorted by key; yields the pairs of ids that share a key and may be similar."""

    def bucket(cols):
        n = len(cols[0])
        for i in range(0, n, 128):  # small blocks, that a worker holds little beside its rows
            left = [c[i : i + 128, None] for c in cols]
            for j in range(i, n, 1024):
                right = [c[None, j : j + 1024] for c in cols]
                x, y = np.nonzero(_close(left, right, similarity))
                yield cols[0][i + x], cols[0][j + y]

    def runs(key, *cols):
        """Pairs of some whole buckets, in parts."""
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(head, len(key)))
        mixed = np.minimum.reduceat(cols[1], head) < np.maximum.reduceat(cols[1], head)
        two = head[mixed & (size == 2)]
        ok = _close([c[two] for c in cols], [c[two + 1] for c in cols], similarity)
        yield cols[0][two[ok]], cols[0][two[ok] + 1]
        for lo, n in zip(head[mixed & (size > 2)].tolist(), size[mixed & (size > 2)].tolist(), strict=True):
            yield from bucket([c[lo : lo + n] for c in cols])

    def merged(found):
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0)

    def run(batches):
        rest, found, n, limit = [np.zeros(0, np.int64)] * 5, [], 0, 200_000
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                now, cut = rest, len(rest[0])
            else:
                now = [np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, batch.columns, strict=True)]
                cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last bucket may go on
            rest = [c[cut:] for c in now]
            for a, b in runs(*(c[:cut] for c in now)) if cut else ():
                found.append((a, b))
                n += len(a)
                if n > 2 * limit or len(found) > 20_000:
                    both = merged(found)  # a pair that shares many shingles here is handed on once
                    found, n = [(both[:, 0], both[:, 1])], len(both)
                    if n > limit:
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
                        found, n = [], 0
        if n:
            both = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


class _Nodes:
    """The nodes that can have a partner, and the groups they are in so far."""

    def __init__(self, scratch: Scratch, made: DataFrame, texts: DataFrame, shingle: int, similarity: float):
        self.scratch, self.similarity, self.turn = scratch, similarity, 0
        rows = made.select("id", "size", F.posexplode("first").alias("place", "key"))
        often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # (key, id, size, place, n) of the shingles in several nodes' prefixes
        with more_partitions(scratch.spark, WIDE):
            shared = scratch.save(rows.join(often, "key").select("key", "id", "place", "size", "n"))
        most = shared.count()
        ids = scratch.save(self._partnered(shared).select("id").distinct(), most)
        self.count = ids.count()
        #: (key, id, place, size) of the shingles that can still settle something.
        self.rows = scratch.save(shared.join(ids, "id", "left_semi").select("key", "id", "place", "size"), most)
        self.n_rows = self.rows.count()
        scratch.drop(shared)

        @F.arrow_udf("array<long>")
        def whole(col: pa.Array) -> pa.Array:
            return _lists(list(_distinct(col, shingle)), len(col))

        # texts are moved and cut into shingles once, those of nodes that can have a partner only
        self.sets = scratch.save(texts.join(ids, "id", "left_semi").select("id", whole("text").alias("set")))
        self.root = scratch.save(ids.select("id", F.col("id").alias("root")), self.count)
        scratch.drop(ids)

    def _partnered(self, shared: DataFrame) -> DataFrame:
        """(id) of the nodes that have a hot shingle, or share enough others with some node.

        At most ``HOT`` nodes meet at a shingle here.
        """
        hot = shared.where(F.col("n") > HOT).groupBy("id").agg(F.count("*").alias("hot"))
        # each row carries how many hot shingles its node has, so that pairs need no join of their own
        cool = shared.where(F.col("n") <= HOT).select("key", "id", "size").join(hot, "id", "left").select("key", "id", "size", F.coalesce("hot", F.lit(0)).alias("hot"))
        pairs = cool.join(cool.toDF("key", "b", "nb", "hot_b"), "key").where("id > b").groupBy("id", "size", "hot", "b", "nb", "hot_b").agg(F.count("*").alias("c"))
        # what they may share besides are hot shingles, of which each has a few
        near = pairs.where(F.col("c") + F.least("hot", "hot_b") >= _shared_at_least(F.col("size"), F.col("nb"), self.similarity))
        return near.select(F.explode(F.array("id", "b")).alias("id")).union(hot.select("id"))

    def placed(self, rows: DataFrame, node: str = "id", root: str = "root") -> DataFrame:
        return rows.join(self.root.withColumnsRenamed({"id": node, "root": root}), node)

    def compare(self, pairs: DataFrame) -> int:
        """Join the groups of the saved pairs (a, b) that are similar enough; returns how many are."""
        own = lambda end: self.sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}"))
        both = pairs.join(own("b"), "b").join(own("a"), "a")
        n = F.size(F.array_intersect("set_a", "set_b"))
        near = both.where(n / (F.size("set_a") + F.size("set_b") - n) >= self.similarity)
        found = self.scratch.save(near.select("a", "b").distinct(), self.count)
        n_found = found.count()
        if n_found:
            # only the groups are joined anew: the smallest node of each stands for it
            links = self.placed(self.placed(found, "a", "ra"), "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            new = components(links, self.scratch, most=self.count)
            moved = self.root.join(new.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("id", F.coalesce("new", "root").alias("root"))
            old, self.root = self.root, self.scratch.save(moved, self.count)
            self.scratch.drop(old, new)
        self.scratch.drop(pairs, found)
        return n_found

    def unsettled(self) -> DataFrame:
        """Rows (key, id, place, size, root, p, n) of the shingles that nodes of different groups have; p: a pivot, n: how many have it."""
        now = self.placed(self.rows.select("key", "id", "place", "size"))
        rank = F.xxhash64("id", "key", F.lit(self.turn)) if self.turn else F.col("id")
        pivot = now.groupBy("key").agg(F.min_by(F.struct("id", "root", "place", "size"), rank).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
        old, self.rows = self.rows, self.scratch.save(now.join(pivot.where("lo < hi").select("key", "p", "n"), "key"), self.n_rows)
        self.scratch.drop(old)
        self.turn += 1
        return self.rows

    def pivots(self) -> DataFrame:
        """(a, b): each node with one pivot of another group, the one it shares most of its prefix with, if that is half of what it takes or more."""
        names = ["id", "root", "place", "size"]
        met = self.unsettled().select(*names, *(f"p.{c}" for c in names)).toDF(*names, *(f"p_{c}" for c in names))
        met = met.where(F.col("root") != F.col("p_root")).groupBy("id", "size", "p_id", "p_size").agg(F.count("*").alias("n"))
        met = met.where(2 * F.col("n") >= _shared_at_least(F.col("size"), F.col("p_size"), self.similarity))
        return self.scratch.save(met.groupBy(F.col("id").alias("a")).agg(F.max_by("p_id", F.struct("n", -F.col("p_id"))).alias("b")), self.count)

    def all_pairs(self) -> DataFrame:
        """(a, b): all pairs of nodes of different groups that may be similar.

        A shingle of more than ``BLOCK`` nodes is dealt into cells, of which
        every two meet under a key of their own.  Of the pairs that some shared
        shingle proposes those stay that share enough of their prefixes.
        """
        cells = F.ceil(F.col("n") / BLOCK).cast("int")
        all_ = self.unsettled().select("key", "id", "root", "place", "size", cells.alias("cells"))
        rows = all_.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        key = F.when(F.col("cells") > 1, F.xxhash64("key", F.least("cell", "other"), F.greatest("cell", "other"))).otherwise(F.col("key"))
        rows = rows.select(key.alias("key"), "id", "root", F.col("place").cast("long"), F.col("size").cast("long"))
        met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(self.similarity), "a long, b long").distinct()
        # nodes of different groups have all their common shingles among these rows
        keys = self.scratch.save(all_.groupBy("id", "size").agg(F.collect_list("key").alias("keys")), self.n_rows)
        own = lambda end: keys.select(F.col("id").alias(end), F.col("size").alias(f"n{end}"), F.col("keys").alias(f"keys_{end}"))
        both = met.join(own("b"), "b").join(own("a"), "a")
        enough = F.size(F.array_intersect("keys_a", "keys_b")) >= _shared_at_least(F.col("na"), F.col("nb"), self.similarity)
        found = self.scratch.save(both.where(enough).select("a", "b").distinct())
        self.scratch.drop(keys)
        return found

    def settle(self) -> DataFrame:
        """(a, b): each node that isn't the smallest of its group with that one; nothing else is needed any more."""
        self.scratch.drop(self.sets, self.rows)
        return self.root.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """(id, component): component is the smallest id reachable over pairs of ``similarity`` or more, the row's own included.

    Defined results: null and wordless texts have the empty set and are similar
    to each other only; a text of fewer words than a shingle is one shingle;
    rows with a null id have a null component and link nothing; rows that
    repeat an id are one node, linked by any of their texts; an empty table
    gives an empty one; other columns of ``docs`` don't matter.
    """
    scratch = Scratch(docs.sparkSession, "similar", docs)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    made = scratch.save(_sketched(texts, shingle, similarity))
    # saved, so that no aggregate shares the join's dealing and Spark can split a hot group of copies
    low = scratch.save(made.groupBy("s1", "s2").agg(F.min("id").alias("low")))
    same = made.select("id", "s1", "s2").join(low, ["s1", "s2"])
    copies = same.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    unique = made.join(low.withColumnRenamed("low", "id"), ["s1", "s2", "id"], "left_semi").where("size > 0")
    nodes = _Nodes(scratch, unique, texts, shingle, similarity)

    # the covering: nodes of equal fingerprints, and fingerprints within the radius
    fps = scratch.save(unique.select("id", "fp").join(nodes.root.select("id"), "id", "left_semi"), 2 * nodes.count)
    first = fps.groupBy("fp").agg(F.min("id").alias("low"))
    linked = simhash.links(first.select("fp"), scratch, radius, nodes.count).distinct()
    near = linked.join(first.withColumnsRenamed({"fp": "a", "low": "x"}), "a").join(first.withColumnsRenamed({"fp": "b", "low": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = fps.join(first, "fp").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b"))
    nodes.compare(scratch.save(near.union(equal), 2 * nodes.count))
    scratch.drop(fps)

    for _ in range(ROUNDS):
        if 50 * nodes.compare(nodes.pivots()) <= nodes.count:
            break
    nodes.compare(nodes.all_pairs())

    root = components(copies.union(nodes.settle()), scratch).withColumnsRenamed({"node": "id", "root": "component"})
    got = made.select("id").join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return got.union(docs.where(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long")))
