"""Similarity of two values: 0 to 1."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import simple, spaced, word_set


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    """A similarity in two steps: what each value is turned into, once, and how two of these compare."""

    prepare: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]

    def __call__(self, a: Column, b: Column) -> Column:
        return self.compare(self.prepare(a), self.prepare(b))


def _words(norm: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: word_set(norm(c))


def _jaccard(x: Column, y: Column) -> Column:
    common = F.size(F.array_intersect(x, y))
    return _share(common, F.size(x) + F.size(y) - common)


def _recall(x: Column, y: Column) -> Column:
    return _share(F.size(F.array_intersect(x, y)), F.size(y))


def _covered(x: Column, y: Column) -> Column:
    return F.when((y["text"] != "") & F.contains(x["text"], y["text"]), F.lit(1.0)).otherwise(_recall(x["words"], y["words"]))


def _text_and_words(c: Column) -> Column:
    return F.struct(spaced(c).alias("text"), word_set(spaced(c)).alias("words"))


#: Common words over all words; the gold value's words that the prediction has (two normal forms);
#: 1 if the prediction contains the gold value, else its words.
JACCARD = Measure(_words(spaced), _jaccard)
RECALL = Measure(_words(simple), _recall)
RECALL_SPACED = Measure(_words(spaced), _recall)
COVERAGE = Measure(_text_and_words, _covered)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Common words over all words; ``empty``: the value where both have none."""
    x, y = JACCARD.prepare(a), JACCARD.prepare(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(empty)).otherwise(_jaccard(x, y))


def token_recall(pred: Column, gold: Column) -> Column:
    return RECALL(pred, gold)


def span_coverage(pred: Column, gold: Column) -> Column:
    return COVERAGE(pred, gold)


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    common = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    return _share(common, (e1 - s1) + (e2 - s2) - common)


def _sequence_ratio(a, b):
    from difflib import SequenceMatcher

    import pyarrow as pa

    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def _indel_ratio(a, b):
    import pyarrow as pa

    return pa.array([None if x is None or y is None else indel(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def indel(x: str, y: str) -> float:
    """2 * LCS / (len + len), the LCS by bit-parallel rows."""
    if not x and not y:
        return 1.0
    where: dict[str, int] = {}
    for i, ch in enumerate(x):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for ch in y:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


def letters_in_common(x: str, y: str) -> float:
    """2 * common letters / (len + len), in any order: neither ratio can be more."""
    from collections import Counter

    if not x and not y:
        return 1.0
    a, b = Counter(x), Counter(y)
    return 2 * sum(min(n, b[c]) for c, n in a.items() if c in b) / (len(x) + len(y))


def sequence_at_least(x: str, y: str, least: float) -> float | None:
    """difflib's ratio if it is ``least`` or more, else None.

    What difflib matches is a common subsequence of common letters, so length,
    letters and the longest common subsequence rule most pairs out before it.
    """
    from difflib import SequenceMatcher

    n = len(x) + len(y)
    if n and 2 * min(len(x), len(y)) < least * n:
        return None
    if letters_in_common(x, y) < least or indel(x, y) < least:
        return None
    ratio = SequenceMatcher(None, x, y).ratio()
    return ratio if ratio >= least else None


#: Slack for comparing bounds that are computed in another order than scores.
EPSILON = 1e-9


def _on(f, x: Column, y: Column) -> Column:
    return F.arrow_udf("double")(f)(x, y)


def sequence_ratio(a: Column, b: Column) -> Column:
    """difflib's ratio of the values without signs and in lower case (Python: Spark has no such function)."""
    return _on(_sequence_ratio, simple(a), simple(b))


def edit_ratio(a: Column, b: Column, package: bool = False) -> Column:
    """Insert/delete ratio if ``package``, else the sequence ratio that stands in for it on a plain install."""
    return _on(_indel_ratio if package else _sequence_ratio, simple(a), simple(b))


def _combined(package: bool) -> Callable[[Column, Column], Column]:
    def compare(x: Column, y: Column) -> Column:
        ratio = _on(_sequence_ratio, x["text"], y["text"])
        edit = _on(_indel_ratio, x["text"], y["text"]) if package else ratio
        return 0.4 * _recall(x["words"], y["words"]) + 0.3 * edit + 0.3 * ratio

    return compare


def _simple_and_words(c: Column) -> Column:
    return F.struct(simple(c).alias("text"), word_set(simple(c)).alias("words"))


#: 0.4 word recall + 0.3 edit ratio + 0.3 sequence ratio, on a plain install and with the edit-distance package.
COMBINED = Measure(_simple_and_words, _combined(False))
COMBINED_PACKAGE = Measure(_simple_and_words, _combined(True))


def combined(pred: Column, gold: Column, package: bool = False) -> Column:
    return (COMBINED_PACKAGE if package else COMBINED)(pred, gold)
