"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period p that is at least ``repeats``
periods and ``least`` words long and can't be extended.  It holds at least
``repeats`` points of the grid 0, p, 2p, ..., so for each period only the words
at jp and (j+1)p are compared at first: n/p probes for a period, n ln n for a
text.  Where ``repeats`` neighbouring grid points have one word, the words
between are compared chunk by chunk, and what holds is extended both ways.

Periods are tried from small to large, by powers of two; grid points whose
whole chain lies in a run found before are skipped.  That loses nothing: two
periods that share so long a stretch have a common divisor as a period of it
(Fine and Wilf), so what such a chain could find is the run found before.  A
multiple of a run's period that is found in spite of this has the run's own
bounds and goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import bounded_batches
from quillspan.llm.words import Texts, whole_texts

#: Grid points that are probed at once, and words in the first chunk that is compared.
POINTS, CHUNK = 1 << 19, 8


def _grid(first: np.ndarray, low: int, high: int, repeats: int):
    """Batches (begin, end, period, points) of the texts' grids for the periods in [low, high), each of about ``POINTS`` points."""
    size = np.diff(first)
    top = np.minimum(high - 1, size // repeats)
    n = np.maximum(top - low + 1, 0)
    text = np.repeat(np.arange(len(size)), n)
    period = low + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    points = (size[text] - 1) // period + 1
    total, at = np.cumsum(points), 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + POINTS, "right")))
        yield first[text[at:to]], first[text[at:to] + 1], period[at:to], points[at:to]
        at = to


def _chains(words: np.ndarray, begin, end, period, points, repeats: int):
    """(position, period, begin, end) of the grid points that start ``repeats`` equal words on their grid."""
    head = np.cumsum(points) - points
    group = np.repeat(np.arange(len(points)), points)
    at = begin[group] + (np.arange(len(group)) - head[group]) * period[group]
    word = words[at]
    equal = word[1:] == word[:-1]
    equal &= group[1:] == group[:-1]
    chain = equal
    for k in range(1, repeats - 1):
        chain = chain[: len(equal) - k] & equal[k:]
    found = np.flatnonzero(chain)
    g = group[found]
    return at[found], period[g], begin[g], end[g]


def _agreeing(words: np.ndarray, at: np.ndarray, period: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (or, ``way`` -1, before it), ``room`` at most, equal the word a period later."""
    same, left, width = np.zeros(len(at), np.int64), np.flatnonzero(room > 0), CHUNK
    while len(left):
        step = np.arange(width)
        span = np.minimum(room[left] - same[left], width)
        start = at[left] + (same[left] if way > 0 else -same[left] - 1)
        own = np.where(step < span[:, None], start[:, None] + way * step, start[:, None])
        differs = (words[own] != words[own + period[left, None]]) & (step < span[:, None])
        n = np.where(differs.any(1), differs.argmax(1), span)
        same[left] += n
        left = left[(n == span) & (same[left] < room[left])]
        width = min(2 * width, max(CHUNK, POINTS // max(len(left), 1)))
    return same


def find_runs(words: np.ndarray, first: np.ndarray, repeats: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run in texts of word codes, by start, then period; text i is words[first[i] : first[i + 1]]."""
    runs = np.zeros((0, 3), np.int64)
    most, low = int(np.diff(first).max(initial=0)) // repeats, 1
    while low <= most:
        new, order = [runs], np.argsort(runs[:, 0], kind="stable")
        starts, reach = runs[order, 0], np.maximum.accumulate(runs[order, 1])
        for part in _grid(first, low, 2 * low, repeats):
            at, period, begin, end = _chains(words, *part, repeats)
            if len(runs):
                before = np.searchsorted(starts, at, "right") - 1
                fresh = (before < 0) | (reach[before] <= at + (repeats - 1) * period)
                at, period, begin, end = at[fresh], period[fresh], begin[fresh], end[fresh]
            whole = _agreeing(words, at, period, period, 1) == period
            at, period, begin, end = at[whole], period[whole], begin[whole], end[whole]
            # neighbouring points of one grid that agree up to the next are one stretch; only its ends are extended
            joins = (at[1:] == at[:-1] + period[1:]) & (period[1:] == period[:-1]) & (begin[1:] == begin[:-1])
            left, right = np.flatnonzero(np.concatenate(([True], ~joins))[: len(at)]), np.flatnonzero(np.concatenate((~joins, [True]))[: len(at)])
            p, lo, hi = period[left], at[left], at[right] + period[right]
            lo = lo - _agreeing(words, lo, p, lo - begin[left], -1)
            hi = hi + _agreeing(words, hi, p, end[left] - p - hi, 1) + p
            long = hi - lo >= np.maximum(least, repeats * p)
            new.append(np.stack((lo[long], hi[long], p[long]), axis=1))
        runs = np.concatenate(new)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        again = np.zeros(len(runs), bool)
        again[1:] = (runs[1:, :2] == runs[:-1, :2]).all(1)
        runs, low = runs[~again], 2 * low
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def kept_text(texts: Texts, stay: np.ndarray) -> list[str]:
    """For each text its words that ``stay``, joined by one space."""
    out, done = [[] for _ in texts.rows], 0
    for b in texts.blocks:
        own = stay[done : done + b.n_words]
        done += b.n_words
        edge = np.zeros(len(b.buf) + 2, np.int8)
        edge[b.starts[own]] += 1
        np.subtract.at(edge, b.ends[own] + 1, 1)
        flat = np.where(b.word, b.buf, 32).astype(np.uint8)[np.cumsum(edge[: len(b.buf)]) > 0].tobytes()
        size = np.concatenate(([0], np.cumsum((b.ends - b.starts + 1) * own)))
        for p in range(len(b.rows)):
            a, e = size[b.first[p]], size[b.first[p + 1]]
            if e > a:
                out[p].append(flat[a : e - 1].decode())
    return [" ".join(o) for o in out]


RUN = "array<struct<start: long, length: long, period: long>>"


def collapse_runs(docs: DataFrame, text_col: str = "text", repeats: int = 4, least: int = 6) -> DataFrame:
    """(row, n_words, runs, collapsed) for every row of ``docs``.

    ``row`` is a struct of the row's own columns, so columns of any name pass
    through; ``runs`` (start, length, period, in words) by start, then period;
    ``collapsed`` the text without the words that a run holds after its first
    period, the others joined by one space.  Null and empty texts and texts
    of blanks have no words, no runs and an empty ``collapsed``; repeated rows
    are treated alike; an empty table gives an empty one.  A text is read
    whole, its words as 64-bit hashes of their bytes (two words are taken for
    one with a likelihood of 2^-64).
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(f"n_words long, runs {RUN}, collapsed string")
    def of(col: pa.Array) -> pa.Array:
        n, kept = np.zeros(len(col), np.int64), [""] * len(col)
        owner, found = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        for t in whole_texts(col):
            start, end, period = find_runs(t.hashes, t.first, repeats, least)
            gone = np.zeros(len(t.hashes) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.subtract.at(gone, end, 1)
            for row, text in zip(t.rows.tolist(), kept_text(t, np.cumsum(gone)[:-1] == 0), strict=True):
                kept[row] = text
            n[t.rows] = np.diff(t.first)
            text = np.searchsorted(t.first, start, "right") - 1
            owner.append(t.rows[text])
            found.append(np.stack((start - t.first[text], end - start, period), axis=1))
        owner, found = np.concatenate(owner), np.concatenate(found)
        offsets = np.searchsorted(owner, np.arange(len(col) + 1))
        runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], ["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(n), runs, pa.array(kept, pa.string())], ["n_words", "runs", "collapsed"])

    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", of(F.col("row")[text_col].cast("string")).alias("c")).select("row", "c.*")
