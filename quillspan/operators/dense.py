"""Dense search in blocks: matrix products over packed vectors, a partial top k from each block.

A group's chunks and queries are dealt into blocks; every block of queries
meets every block of chunks in a task of its own, and of that only k rows a
query leave it.  The best of a query's partial lists are then its top k, so no
row for a pair of chunk and query is ever made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Chunks and queries in a block.
CHUNKS, QUERIES = 8192, 1024
MEASURES = ("cosine", "dot", "l2")


def _exact(q: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """Scores of paired rows, summed in one order, so that equal vectors score alike."""
    if measure == "l2":
        return 1 / (1 + np.sqrt(((q - c) ** 2).sum(1)))
    dot = (q * c).sum(1)
    return dot if measure == "dot" else dot / np.maximum(np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)), 1e-10)


def _rough(q: np.ndarray, c: np.ndarray, measure: str) -> np.ndarray:
    """All scores of a block up to rounding, by one matrix product."""
    dot = q @ c.T
    if measure == "dot":
        return dot
    a, b = (q * q).sum(1)[:, None], (c * c).sum(1)[None, :]
    return dot / np.maximum(np.sqrt(a) * np.sqrt(b), 1e-10) if measure == "cosine" else -np.maximum(a + b - 2 * dot, 0)


def block_top(ids: np.ndarray, chunks: np.ndarray, queries: np.ndarray, k: int, measure: str):
    """(query row, chunk row, score) of each query's best ``k`` chunks, ties by the smaller id.

    The product proposes what may be among them, with slack for its rounding;
    those pairs are scored again in one fixed order of summation.
    """
    rough = _rough(queries, chunks, measure)
    if rough.shape[1] > k:
        last = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.abs(last) + (queries**2).sum(1) + (chunks**2).sum(1).max())
        q, c = np.nonzero(rough >= (last - slack)[:, None])
    else:
        q, c = (x.ravel() for x in np.indices(rough.shape))
    score = np.empty(len(q))
    for at in range(0, len(q), 65_536):
        part = slice(at, at + 65_536)
        score[part] = _exact(queries[q[part]], chunks[c[part]], measure)
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    best = rank <= k
    return q[best], c[best], score[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _whole(vector: str) -> Column:
    """Vectors with a component, none of them null."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())


def search(chunks: DataFrame, queries: DataFrame, on: str, k: int, measure: str) -> DataFrame:
    """(on, query_id, chunk_id, score): candidates that hold each query's ``k`` best chunks (on, chunk_id, vector) of its group.

    Chunk ids are integers.  Only vectors of one length compare; null vectors
    and those with a null component match nothing.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure}")
    c = chunks.where(_whole("vector")).select(on, "chunk_id", F.size("vector").alias("d"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    q = queries.where(_whole("query_vector")).select(on, "query_id", F.size("query_vector").alias("d"), F.transform("query_vector", lambda x: x.cast("double")).alias("v"))
    by = [on, "d"]
    blocks = c.groupBy(*by).agg(F.ceil(F.count("*") / CHUNKS).cast("int").alias("bc")).join(q.groupBy(*by).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("bq")), by)
    cell = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = c.join(blocks, by).select(*by, "chunk_id", "v", cell("chunk_id", "bc").alias("cc"), each("bq").alias("cq"))
    q = q.join(blocks, by).select(*by, "query_id", "v", cell("query_id", "bq").alias("cq"), each("bc").alias("cc"))
    c, q = c.toDF(*c.columns), q.toDF(*q.columns)  # the two sides may be one table
    schema = StructType([q.schema[on], q.schema["query_id"], c.schema["chunk_id"], StructField("score", DoubleType())])
    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])

    def meet(key, asked: pa.Table, own: pa.Table) -> pa.Table:
        if not asked.num_rows or not own.num_rows:
            return arrow.empty_table()
        ids = own["chunk_id"].combine_chunks()
        i, j, score = block_top(ids.to_numpy(zero_copy_only=False), _matrix(own["v"]), _matrix(asked["v"]), k, measure)
        group = pa.array([key[0].as_py()] * len(i), arrow.field(0).type)
        return pa.Table.from_arrays([group, asked["query_id"].combine_chunks().take(pa.array(i)), ids.take(pa.array(j)), pa.array(score)], schema=arrow)

    deal = [*by, "cc", "cq"]
    return q.groupBy(*deal).cogroup(c.groupBy(*deal)).applyInArrow(meet, schema)
