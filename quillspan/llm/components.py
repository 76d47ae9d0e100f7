"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch


class Forest:
    """Union-find over the integers met so far; keeps the links that joined two sets."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            x, y = min(x, y), max(x, y)
            self.parent[y] = x
            self.links.append((a, b))

    def stars(self) -> list[tuple[int, int]]:
        """Each member that isn't the smallest of its set, with the smallest."""
        return [(x, r) for x in self.parent if (r := self.find(x)) != x]


#: A task hands its links on when it has met this many integers.
FOREST_LIMIT = 200_000


def _thin(batches):
    """Within a task, replace links by stars to the smallest member of each set: fewer, and already nearly joined."""
    forest = Forest()

    def out():
        s = np.array(forest.stars(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.parent) > FOREST_LIMIT:
            yield out()
            forest = Forest()
    yield out()


#: Up to so many links, after thinning, one task joins them all; it holds a few tens of MB.
ONE_TASK = 100_000


def _join_all(batches):
    """(node, root) for every integer of the links, in one task."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.parent.setdefault(a, a)
            forest.parent.setdefault(b, b)
            forest.join(a, b)
    both = np.array([(x, forest.find(x)) for x in forest.parent], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), saved; root is the smallest node reachable.

    Each task first thins its links to stars.  If few are left (``ONE_TASK``,
    measured), one task joins them; otherwise by alternating star contraction:
    each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise, until only stars are left.  A hub's links
    are spread by hash of the other end and its minimum is pre-aggregated;
    only skewed joins, which Spark can split, meet on a hub.  Each round is
    written to the shared folder.  Both ways give the same result.
    ``most``: a bound on the links, if it is known.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now = scratch.save(ordered(edges.select("a", "b").mapInArrow(_thin, "a long, b long")).distinct(), most)
    size = _measure(now)
    if size[0] <= ONE_TASK:
        done = scratch.save(now.coalesce(1).mapInArrow(_join_all, "node long, root long"))
        scratch.drop(now)
        return done
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        nxt = scratch.save(small.distinct())
        scratch.drop(now)
        before, size, now = size, _measure(nxt), nxt
        if before == size and _is_stars(now):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    done = scratch.save(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    scratch.drop(now)
    return done


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _is_stars(edges: DataFrame) -> bool:
    return not edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").take(1)
