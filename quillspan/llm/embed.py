"""Embedding near-duplicates by a random-projection tree forest.

Equal vectors of a label are one node with a multiplicity.  Trees are grown on
a bounded sample, a few for each label whose nodes don't fit one leaf: every
inner node splits at the median along a random direction, recursively, and
vectors within a margin of the split go to both sides (spill), so that close
pairs rarely part; several trees make up for the rest.  All nodes are then
sent down all trees.  Leaves that more nodes reach than they should hold, as
the sample is bounded and the data isn't, are split further: for each such leaf
a tree is grown from a bounded sample of its own nodes, in the executors, and
its nodes are sent down that, until no leaf is too large or none can be split
(vectors closer than any margin).  Nodes that share a leaf are compared exactly, in double
precision; the links that join groups are united to components, and within
each component every pair is compared to count links.

A leaf or component of more than ``BLOCK`` nodes is dealt into cells, of which
every two meet in a task of their own, so that no task holds more than two
cells, however many near copies a vector has.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.scratch import Scratch
from quillspan.llm.words import mix

#: Cosine from which vectors are linked; trees; nodes a leaf should hold; rows the trees are grown on.
COSINE, TREES, LEAF, SAMPLE = 0.98, 6, 1024, 20_000
#: Nodes of a group that one task holds, twice at most.
BLOCK = 2048
#: Nodes that a large leaf's own tree is grown on, nodes that one task sends down it, and times that leaves are split further.
LEAF_SAMPLE, ROUTE, DEPTH = 2048, 1 << 16, 6
#: Half the width of the spilled band, in units of unit vectors, and the share of a node's points it may take.
MARGIN, MOST_SPILL = 0.02, 0.2


class Tree:
    """Random splits as arrays: direction, threshold and margin of inner nodes, children (negative: leaf number)."""

    def __init__(self, points: np.ndarray, least: int, rng: np.random.Generator):
        self.directions, self.cuts, self.margins, self.children = [], [], [], []
        self.leaves = 0
        self.root = self._grow(points, max(least, 8), rng)

    def _grow(self, points: np.ndarray, least: int, rng) -> int:
        if len(points) > least:
            for _ in range(4):
                d = rng.normal(size=points.shape[1])
                d /= np.linalg.norm(d)
                p = points @ d
                cut = float(np.median(p))
                margin = min(MARGIN, float(np.quantile(np.abs(p - cut), MOST_SPILL)))
                left, right = p <= cut + margin, p >= cut - margin
                if max(left.sum(), right.sum()) <= 0.8 * len(points):
                    n = len(self.cuts)
                    self.directions.append(d)
                    self.cuts.append(cut)
                    self.margins.append(margin)
                    self.children.append(None)
                    self.children[n] = (self._grow(points[left], least, rng), self._grow(points[right], least, rng))
                    return n
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray):
        """(point, leaf) for every leaf that a point reaches."""
        found, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, i = todo.pop()
            if node < 0 or not len(i):
                found.append((i, np.full(len(i), -node)))
                continue
            p = points[i] @ self.directions[node]
            left, right = self.children[node]
            todo.append((left, i[p <= self.cuts[node] + self.margins[node]]))
            todo.append((right, i[p >= self.cuts[node] - self.margins[node]]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _units(vectors: pa.Array, n: int) -> np.ndarray:
    v = np.asarray(vectors.flatten(), np.float64).reshape(n, -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def grow_forest(nodes: DataFrame, trees: int, leaf: int, sample: int, seed: int = 11) -> dict:
    """{(label, dimension): trees} for the labels with more than ``leaf`` nodes, from ``sample`` nodes at most."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    # the sample is bounded, so is the number of labels that can have a point in it
    got = nodes.join(sizes, ["label", "dim"]).select("label", "dim", "n", "vec").orderBy(F.xxhash64("vec"), "label").limit(sample).toArrow()
    groups: dict = {}
    for k, (label, dim, n) in enumerate(zip(*(got.column(c).to_pylist() for c in range(3)), strict=True)):
        groups.setdefault((label, dim), (n, []))[1].append(k)
    vectors = got.column(3).combine_chunks()
    rng = np.random.default_rng(seed)
    out = {}
    for key in sorted(groups):
        n, rows = groups[key]
        points = _units(vectors.take(pa.array(rows)), len(rows))
        least = int(leaf * len(rows) / n)
        out[key] = [Tree(points, least, rng) for _ in range(trees)]
    return out


def _router(forest):
    @F.arrow_udf("array<long>")
    def leaves(label: pa.Array, dim: pa.Array, vec: pa.Array) -> pa.Array:
        labels, dims = label.to_pylist(), dim.to_pylist()
        groups: dict = {}
        for k, key in enumerate(zip(labels, dims, strict=True)):
            groups.setdefault(key, []).append(k)
        rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for key, own in groups.items():
            own = np.array(own)
            trees = forest.value.get(key)
            if not trees:
                rows.append(own)
                codes.append(np.zeros(len(own), np.int64))
                continue
            points = _units(vec.take(pa.array(own)), len(own))
            for t, tree in enumerate(trees):
                i, leaf = tree.route(points)
                rows.append(own[i])
                codes.append((t << 32) + leaf)
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(labels) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[order]))

    return leaves


def _groups(batches, keys: int):
    """The columns of each run of equal leading ``keys`` columns in rows sorted by them, across batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            rest = table
            continue
        change = np.zeros(table.num_rows, bool)
        for c in range(keys):
            v = table.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        heads = np.concatenate(([0], np.flatnonzero(change)))
        for lo, hi in zip(heads[:-1], heads[1:], strict=True):
            yield table.slice(lo, hi - lo)
        rest = table.slice(heads[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _grow_leaves(leaf: int, seed: int):
    """Reads sampled rows (label, dim, leaf, n, vec) sorted by the first three; yields a tree for each leaf that can be split."""

    def run(batches):
        for t in _groups(batches, 3):
            label, dim, code, n = (t.column(c)[0].as_py() for c in range(4))
            points = _units(t.column(4).combine_chunks(), t.num_rows)
            tree = Tree(points, int(leaf * len(points) / n), np.random.default_rng([seed, code & 0xFFFFFFFF]))
            if tree.leaves > 1:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (label, dim, code, n)] + [pa.array([pickle.dumps(tree)], pa.binary())], ["label", "dim", "leaf", "n", "tree"])

    return run


def _send_down(batches):
    """Reads rows (label, dim, leaf, part, kind, tree, node, vec) sorted by the first five, each part's tree before its nodes; yields (label, dim, leaf, node, vec) with the leaves below."""
    now, tree = None, None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
        kind = batch.column(4).to_numpy()
        head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1) | (kind[1:] != kind[:-1]))))
        for lo, hi in zip(head, np.append(head[1:], len(key)), strict=True):
            if kind[lo] == 0:
                now, tree = tuple(key[lo]), pickle.loads(batch.column(5)[int(lo)].as_py())
                continue
            assert tuple(key[lo]) == now, "a tree comes before its nodes"
            part = batch.slice(lo, hi - lo)
            i, sub = tree.route(_units(part.column(7), part.num_rows))
            take = pa.array(i)
            code = mix(np.full(len(i), key[lo, 2], np.int64).view(np.uint64) ^ mix(sub.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(code), part.column(6).take(take), part.column(7).take(take)], ["label", "dim", "leaf", "node", "vec"])


def split_leaves(rows: DataFrame, leaf: int, scratch: Scratch, depth: int = DEPTH) -> tuple[DataFrame, bool]:
    """Rows (label, dim, leaf, node, vec) with leaves of more than ``leaf`` nodes split further where they can be, and whether some still have more."""
    keys, done, over = ["label", "dim", "leaf"], [], True
    for level in range(depth):
        large = scratch.save(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > leaf))
        if large.isEmpty():
            over = False
            break
        share = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < F.col("n").cast("double") ** -1 * LEAF_SAMPLE * (1 << 30)
        some = rows.join(large, keys).where(share).select(*keys, "n", "vec").repartition(*keys).sortWithinPartitions(*keys)
        trees = scratch.save(some.mapInArrow(_grow_leaves(leaf, level), "label long, dim long, leaf long, n long, tree binary"))
        if trees.isEmpty():
            break
        parts = F.ceil(F.col("n") / ROUTE).cast("long")
        split = trees.select(*keys, parts.alias("parts"))
        first = trees.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.lit(0).alias("kind"), "tree", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("vec"))
        then = rows.join(split, keys).select(*keys, F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "node", "vec")
        both = first.union(then).repartition(*keys, "part").sortWithinPartitions(*keys, "part", "kind")
        done.append(rows.join(split, keys, "left_anti").select(*keys, "node", "vec"))
        rows = scratch.save(both.mapInArrow(_send_down, "label long, dim long, leaf long, node long, vec array<double>"))
    return functools.reduce(DataFrame.union, done, rows.select(*keys, "node", "vec")), over or bool(done)


def spanning_links(v: np.ndarray, least: float, block: int = 4096) -> list[tuple[int, int]]:
    """Index pairs that hold together the groups of unit vectors linked by cosine >= ``least``."""
    out, left = [], np.arange(len(v))
    if len(v) <= block:
        near = v @ v.T >= least
        np.fill_diagonal(near, False)
        left = np.flatnonzero(near.any(1))
        row_of = lambda x, others: near[x, others]
    else:
        row_of = lambda x, others: v[others] @ v[x] >= least
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = row_of(x, left)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue.extend(found)
                out.extend((x, y) for y in found)
    return out


def _leaf_links(least: float):
    """Reads rows (label, dim, leaf, lo, hi, own, node, vec) sorted by the first five; yields links that hold each block's groups together."""

    def run(batches):
        for t in _groups(batches, 5):
            if t.num_rows > 1:
                ids = t.column(6).to_numpy()
                pairs = np.array(spanning_links(_units(t.column(7).combine_chunks(), len(ids)), least), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    return run


def _count_links(least: float, block: int = 1024):
    """Reads rows (root, lo, hi, own, node, vec, w) sorted by the first three; yields for each node how many vectors of others in its block it is linked with.

    Nodes of one cell meet in the block of that cell with itself only.
    """

    def counted(v, others, w):
        return np.concatenate([(v[at : at + block] @ others.T >= least) @ w for at in range(0, len(v), block)] or [np.zeros(0)])

    def run(batches):
        for t in _groups(batches, 3):
            own, ids, w = (t.column(c).to_numpy() for c in (3, 4, 6))
            v = _units(t.column(5).combine_chunks(), len(ids))
            lo, hi = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            if lo == hi:
                links = counted(v, v, w) - np.where(np.einsum("ij,ij->i", v, v) >= least, w, 0)
            else:
                a, b = own == lo, own == hi
                links = np.zeros(len(ids))
                links[a], links[b] = counted(v[a], v[b], w[b]), counted(v[b], v[a], w[a])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], ["node", "others"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame | None, keys: list[str], columns: list[str], scratch: Scratch) -> DataFrame:
    """Rows (keys, lo, hi, own, columns), sorted by the first ones within partitions of whole blocks.

    ``sizes``: (keys, n), or None if no group is larger.  The rows of a group of more than ``BLOCK`` are in one
    cell each and come once for every cell that theirs meets, their own too.
    """
    large = None if sizes is None else scratch.save(sizes.where(F.col("n") > BLOCK))
    if large is None or large.isEmpty():
        rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(0), "own": F.lit(0)})
    else:
        rows = rows.join(large, keys, "left").withColumn("cells", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    own = [*keys, "lo", "hi"]
    return rows.select(*own, "own", *columns).repartition(*own).sortWithinPartitions(*own)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component, kept): one row per vector.

    Vectors are linked if their labels and dimensions are equal and their
    cosine is ``cosine`` or more.  Null labels and vectors that are null,
    empty, zero or hold a null or a number that isn't finite are linked with
    nothing; so are rows with a null id, whose component is null.  Rows that
    repeat an id are separate vectors.
    """
    scratch = Scratch(vectors.sparkSession, "embed", vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", fit)
    good = rows.where("fit").select("id", "label", "vec")
    nodes = good.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("w")).withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id())
    nodes = scratch.save(nodes)
    forest = vectors.sparkSession.sparkContext.broadcast(grow_forest(nodes, trees, leaf, sample))
    leaves = nodes.select("label", F.col("dim").cast("long").alias("dim"), "node", "vec", F.explode(_router(forest)("label", "dim", "vec")).alias("leaf"))
    keys = ["label", "dim", "leaf"]
    leaves, over = split_leaves(leaves, leaf, scratch)
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("n")) if over or leaf > BLOCK else None
    placed = _dealt(leaves, sizes, keys, ["node", "vec"], scratch)
    root = components(placed.mapInArrow(_leaf_links(cosine), "a long, b long"), scratch)
    member = nodes.join(root, "node")
    low = member.groupBy("root").agg(F.min("low").alias("component"))
    blocks = _dealt(member.select("root", "node", "vec", "w"), root.groupBy("root").agg(F.count("*").alias("n")), ["root"], ["node", "vec", "w"], scratch)
    counted = blocks.mapInArrow(_count_links(cosine), "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))
    found = root.join(low, "root").join(counted, "node").select("node", "component", "others")
    per_node = nodes.join(found, "node", "left").select("label", "vec", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component"))
    joined = good.join(per_node, ["label", "vec"]).select("id", "n_links", "component")
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
