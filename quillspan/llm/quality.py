"""Quality classifier: a factorisation machine over hashed words and text structure.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise
part in linear time as half of (sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2.  Features
are word counts hashed to ``buckets`` dimensions, statistics of the text's
structure (letter case, digits, signs, line and word shapes, repetition) and
its size; nothing else of a row enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import bounded_batches
from quillspan.llm.words import SPACE, blocks

BUCKETS = 1024
STATS = 16


def _class_table() -> np.ndarray:
    """0 other, 1 upper case, 2 lower case, 3 digit, 4 sign, 5 line end, 6 blank, 7 beyond ASCII."""
    t = np.zeros(256, np.uint8)
    t[65:91], t[97:123], t[48:58], t[128:] = 1, 2, 3, 7
    t[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
    t[10], t[[9, 11, 12, 13, 32]] = 5, 6
    return t


CLASSES = _class_table()


def features(col, buckets: int = BUCKETS) -> np.ndarray:
    """One row of features for each text of an Arrow column; all are sums over the whole text, then scaled."""
    n = len(col)
    words = np.zeros((n, buckets), np.float32)
    count = np.zeros((n, 8))
    more = np.zeros((n, 7))  # words, repeats of the word before, words with signs, bytes of words, doubled signs, bare-sign words, long words
    for b in blocks(col, SPACE, margin=0):
        heads = b.offsets[:-1]
        cls = CLASSES[b.buf]
        for k in range(8):
            np.add.at(count[:, k], b.rows, np.add.reduceat(cls == k, heads, dtype=np.int64))
        double = np.zeros(len(cls), bool)
        double[1:] = (cls[1:] == 4) & (b.buf[1:] == b.buf[:-1])
        np.add.at(more[:, 4], b.rows, np.add.reduceat(double, heads, dtype=np.int64))
        if not b.n_words:
            continue
        h = b.word_hashes()
        piece = b.piece_of_word()
        row = b.rows[piece]
        size = b.ends - b.starts
        signs = np.concatenate(([0], np.cumsum(cls == 4)))
        own = signs[b.ends] - signs[b.starts]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (piece[1:] == piece[:-1])
        for k, v in enumerate((np.ones(len(h)), again, own > 0, size, None, own == size, size > 20)):
            if v is not None:
                more[:, k] += np.bincount(row, v, n)
        words += np.bincount(row * buckets + (h % np.uint64(buckets)).astype(np.int64), minlength=n * buckets).reshape(n, buckets).astype(np.float32)
    total = np.maximum(count.sum(1), 1)
    nw = np.maximum(more[:, 0], 1)
    spread = (words > 0).sum(1) / np.minimum(nw, buckets)
    peak = words.max(1) / nw if buckets else 0
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    stats = np.stack((count[:, 1] / letters, count[:, 3] / total, count[:, 4] / total, count[:, 5] / nw, count[:, 7] / total, more[:, 1] / nw, more[:, 2] / nw, more[:, 3] / nw / 10, more[:, 4] / nw, more[:, 5] / nw, more[:, 6] / nw, spread, peak, np.log1p(more[:, 0]) / 5, (more[:, 0] == 0).astype(float), np.log1p(total) / 8), axis=1)
    words = np.log1p(words)
    words /= np.maximum(np.sqrt((words**2).sum(1, keepdims=True)), 1e-9)
    return np.concatenate((words, stats.astype(np.float32)), axis=1)


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) * self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x.astype(np.float64))
        pair = 0.5 * ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(1)
        return _sigmoid(self.bias + x @ self.weights + pair)

    @classmethod
    def constant(cls, size: int) -> FactorisationMachine:
        z = np.zeros(size)
        return cls(0.0, z, np.zeros((size, 1)), z, np.ones(size))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """Fit by Adam on the logistic loss; word features are scaled together, each statistic by its own spread."""
    size = x.shape[1]
    model = FactorisationMachine.constant(size)
    if not len(y):
        return model
    rng = np.random.default_rng(seed)
    model.centre = np.concatenate((np.zeros(size - STATS), x[:, -STATS:].mean(0)))
    model.scale = np.concatenate((np.full(size - STATS, 2.0), 1 / np.maximum(x[:, -STATS:].std(0), 1e-3)))
    x = model.scaled(x).astype(np.float32)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(size), rng.normal(0, 0.01, (size, rank))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            i = order[at : at + 128]
            a = x[i].astype(np.float64)
            av = a @ params[2]
            z = params[0][0] + a @ params[1] + 0.5 * ((av**2).sum(1) - ((a**2) @ (params[2] ** 2)).sum(1))
            r = (_sigmoid(z) - y[i]) / len(i)
            grads = [np.array([r.sum()]), a.T @ r + decay * params[1], a.T @ (r[:, None] * av) - params[2] * ((a**2).T @ r)[:, None] + decay * params[2]]
            step += 1
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    model.bias, model.weights, model.factors = float(params[0][0]), params[1], params[2]
    return model


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, buckets: int = BUCKETS) -> FactorisationMachine:
    """Train on at most ``sample`` labelled rows, those with the smallest hashes of their ids.

    Held-out rows and rows without a label or id are never read for this; a
    document with several labels counts as the lowest of them, documents that
    repeat an id as often as they occur, null texts as empty ones.  Ties of
    the hash go by id.  Rows are put in one order by their values before
    training, so the model doesn't depend on how they arrive.  Without any row
    (an empty table, no label) every score is 0.5.  Only the named columns are
    read, whatever others there are.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("k"), F.col(target).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out("k"))
    chosen = chosen.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)

    def run(batches):
        for batch in batches:
            x = features(batch.column(0), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], ["x", "y"])

    # at most ``sample`` rows of two integers are broadcast
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k").select("t", "y").mapInArrow(run, "x array<float>, y int")
    got = rows.toArrow()
    x = np.array(got.column(0).combine_chunks().flatten()).reshape(-1, buckets + STATS) if got.num_rows else np.zeros((0, buckets + STATS), np.float32)
    y = np.array(got.column(1), dtype=np.float64)
    order = np.lexsort((*x[:, -STATS:].T, y)) if len(y) else slice(0)  # the same order however the rows arrived
    return train(x[order], y[order])


def score(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", buckets: int = BUCKETS, step: int = 512) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, and how likely its whole text is of label 1.

    Null texts are empty; an empty text has a score like any other; long texts
    are read whole, in blocks; repeated rows are scored alike; an empty table
    gives an empty one; ``row`` is a struct, so columns of any name (score
    too) pass through.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def likelihood(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([shared.value.score(features(texts.slice(at, step), buckets)) for at in range(0, len(texts), step)] or [np.zeros(0)]))

    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", likelihood(F.col("row")[text_col].cast("string")).alias("score"))
