"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(grade <= j) = sigmoid(theta_j - w . x) with one weight vector w shared by
all ordered thresholds theta_0 < theta_1 < ...; the severity of a text is its
expected grade, the sum over j of P(grade > j).  Features are the distinct
words of the whole text by 64-bit hash; a screening on the training rows keeps
those whose share among higher grades differs most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality import _sigmoid
from quillspan.llm.scratch import bounded_batches
from quillspan.llm.words import PUNCT, blocks


def distinct_words(col) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of each text, sorted by row; a long text comes in several blocks and counts each word once too."""
    rows, words = [], []
    for b in blocks(col, PUNCT, lower=True):
        if b.n_words:
            both = np.unique(np.stack((b.piece_of_word().astype(np.uint64), b.word_hashes()), axis=1), axis=0)
            rows.append(b.rows[both[:, 0].astype(np.int64)])
            words.append(both[:, 1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    r, h = np.concatenate(rows), np.concatenate(words)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
    return r[new], h[new]


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes with a weight
    weights: np.ndarray
    thresholds: np.ndarray
    sieve: np.ndarray  # by the hash's low 16 bits: may it have a weight?

    def predictor(self, col) -> np.ndarray:
        """w . x for each text of an Arrow column."""
        n = len(col)
        pairs = []
        for b in blocks(col, PUNCT, lower=True):
            h = b.word_hashes()
            i = np.flatnonzero(self.sieve[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.words, h[i]), max(len(self.words) - 1, 0))
            hit = self.words[at] == h[i] if len(self.words) else np.zeros(len(i), bool)
            pairs.append(b.rows[b.piece_of_word()[i[hit]]].astype(np.int64) * (len(self.words) + 1) + at[hit])
        own = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.bincount(own // (len(self.words) + 1), self.weights[own % (len(self.words) + 1)], n) if len(own) else np.zeros(n)

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > j), a column for each threshold."""
        return _sigmoid(eta[:, None] - self.thresholds[None, :])


def screen(rows: np.ndarray, words: np.ndarray, high: np.ndarray, keep: int, least: int = 4) -> np.ndarray:
    """The ``keep`` words, each in ``least`` training rows or more, whose presence tells most about ``high``."""
    uniq, inv = np.unique(words, return_inverse=True)
    seen = np.bincount(inv, minlength=len(uniq))
    hits = np.bincount(inv, high[rows], len(uniq))
    share = high.mean()
    z = np.where(seen >= least, (hits - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9)), 0)
    top = np.argsort(-np.abs(z), kind="stable")[:keep]
    return np.sort(uniq[top[np.abs(z[top]) > 3]])


def train(rows: np.ndarray, words: np.ndarray, grades: np.ndarray, keep: int = 4096, rounds: int = 150, sparse: float = 2e-4, rate: float = 0.1) -> OrdinalModel:
    """Fit by Adam on the likelihood of the grades, with soft thresholding of the weights."""
    levels = int(grades.max()) if len(grades) else 1
    chosen = screen(rows, words, (grades > 0).astype(float), keep) if len(grades) and 0 < (grades > 0).mean() < 1 else np.zeros(0, np.uint64)
    sieve = np.zeros(1 << 16, bool)
    sieve[(chosen & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.searchsorted(chosen, words)
    at = np.minimum(at, max(len(chosen) - 1, 0))
    hit = chosen[at] == words if len(chosen) else np.zeros(len(words), bool)
    r, c = rows[hit], at[hit]
    base = np.array([min(max((grades <= j).mean(), 1e-3), 1 - 1e-3) if len(grades) else 0.999 for j in range(max(levels, 1))])
    theta = np.log(base / (1 - base))
    # ordered by construction: theta_0, then logarithms of the gaps
    free = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 0.1))))
    w = np.zeros(len(chosen))
    n = max(len(grades), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, free)]
    for step in range(1, rounds + 1):
        theta = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
        eta = np.bincount(r, w[c], n) if len(c) else np.zeros(n)
        edge = np.concatenate(([-np.inf], theta, [np.inf]))
        g = grades.astype(int) if len(grades) else np.zeros(n, int)
        hi, lo = _sigmoid(np.minimum(edge[g + 1] - eta, 40)), _sigmoid(np.maximum(edge[g] - eta, -40))
        hi, lo = np.where(np.isinf(edge[g + 1]), 1, hi), np.where(np.isinf(edge[g]), 0, lo)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_eta = (dhi - dlo) / n  # of the negative log-likelihood
        d_theta = np.array([(np.where(g == j, -dhi, 0) + np.where(g == j + 1, dlo, 0)).sum() / n for j in range(len(theta))])
        d_free = np.concatenate(([d_theta.sum()], [d_theta[k:].sum() * np.exp(free[k]) for k in range(1, len(free))]))
        grads = (np.bincount(c, d_eta[r], len(w)) if len(c) else np.zeros(len(w)), d_free)
        for k, (param, grad) in enumerate(zip((w, free), grads, strict=True)):
            m, s = state[k]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w[:] = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
    theta = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
    return OrdinalModel(chosen, w, theta, sieve)


def grade_by_density(rows: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Three grades from a two-valued label: 0 as labelled; of the others, 2 for those with more telling words than their median, else 1."""
    grades = (toxic > 0).astype(int)
    if not len(grades) or not 0 < grades.mean() < 1:
        return grades
    telling = screen(rows, words, grades.astype(float), 64)
    hits = np.bincount(rows, np.isin(words, telling), len(grades))
    return np.where((grades > 0) & (hits > np.median(hits[grades > 0])), 2, grades)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 8000, graded: bool = False) -> OrdinalModel:
    """Train on at most ``sample`` labelled rows, those with the smallest hashes of their ids.

    ``graded``: ``target`` already holds ordered grades from 0; otherwise it is
    two-valued and ``grade_by_density`` refines it, so that grade 2 then means
    "toxic, with more telling words than half of the toxic ones" and severity
    is no more than that.  A document with several labels counts as the
    highest of them, documents that repeat an id as often as they occur, null
    texts as empty ones; labels without an id or value aren't read.  Ties of
    the hash go by id.  Without any row every text has grade 0.  Only the named
    columns are read, whatever others there are.
    """
    bounded_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("k"), F.col(target).cast("int").alias("y")).where("k is not null and y is not null")
    chosen = chosen.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)

    def run(batches):
        for batch in batches:
            row, h = distinct_words(batch.column(0))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists, batch.column(2)], ["k", "x", "y"])

    # at most ``sample`` rows of two integers are broadcast
    got = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k").select("t", "k", "y").mapInArrow(run, "k long, x array<long>, y int").toArrow().sort_by("k")
    lists = got.column(1).combine_chunks()
    y = np.array(got.column(2), dtype=np.int64)
    size = np.diff(np.array(lists.offsets)) if got.num_rows else np.zeros(0, np.int64)
    rows, words = np.repeat(np.arange(len(y)), size), np.array(lists.flatten(), dtype=np.int64).view(np.uint64)
    return train(rows, words, y if graded else grade_by_density(rows, words, y))


def score(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """(row, severity, p_toxic, grade): expected grade, P(grade > 0) and the likeliest grade of every whole text.

    Null texts are empty and have no words; long texts are read whole, in
    blocks, and count each distinct word once; of equally likely grades the
    lowest is taken; repeated rows are scored alike; an empty table gives an
    empty one; ``row`` is a struct, so columns of any name pass through.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("severity double, p_toxic double, grade int")
    def graded(texts: pa.Array) -> pa.Array:
        above = shared.value.above(shared.value.predictor(texts))
        each = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1), axis=1)
        return pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, 0].copy()), pa.array(each.argmax(1).astype(np.int32))], ["severity", "p_toxic", "grade"])

    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", graded(F.col("row")[text_col].cast("string")).alias("g")).select("row", "g.*")
