"""Quality rules: decision lists learned by sequential covering, applied as Spark conditional expressions.

Classes are taken from the rarest to the most frequent; the last is what no
rule decides.  For each of the others rules are grown and pruned in turn: a
rule starts empty and gains the threshold on one statistic that adds most
information (FOIL's gain over all thresholds of all statistics) until it
covers no other class; on rows kept apart from growing, conditions are then
taken off its end while that makes it better.  Rows that a rule covers leave,
and the next one is learned on the rest, until a rule isn't pure enough on the
rows it wasn't grown on.  The list is an ordered CASE over readable
conditions; learned once on a bounded sample, it runs inside Spark's own
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality import held_out
from quillspan.llm.scratch import bounded_batches
from quillspan.llm.words import U64, mix, run_hashes, whole_texts

#: What is counted in a text, all longs.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_signs", "n_doubled", "n_bare", "n_echoes", "n_distinct")
#: The statistics that rules are made of, as SQL over the counts.
STATISTICS = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "sign_share": "n_signs / greatest(n_words, 1)",
    "doubled_share": "n_doubled / greatest(n_words, 1)",
    "bare_share": "n_bare / greatest(n_words, 1)",
    "echo_share": "n_echoes / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}
SYMBOLS = b"#*$%&|<>"


def _byte_kinds() -> dict[str, np.ndarray]:
    kinds = {k: np.zeros(256, bool) for k in ("symbol", "upper", "lower", "digit", "sign", "head")}
    kinds["symbol"][list(SYMBOLS)] = True
    kinds["upper"][65:91], kinds["lower"][97:123], kinds["digit"][48:58] = True, True, True
    kinds["sign"][[b for b in range(33, 127) if not chr(b).isalnum()]] = True
    kinds["head"][:] = [b & 0xC0 != 0x80 for b in range(256)]  # the first byte of a code point
    return kinds


KINDS = _byte_kinds()


def _copies(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    _, code, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[code] > 1


def duplicate_lines(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines with a word, and those of them that equal an earlier one."""
    n = len(col)
    lines = pc.split_pattern(col.cast(pa.large_string()).fill_null(""), "\n")
    row = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    coded = lines.flatten().dictionary_encode()
    code = coded.indices.to_numpy()
    full = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    row, code = row[full], code[full].astype(np.int64)
    total = np.bincount(row, minlength=n)
    distinct = np.unique(row * (len(coded.dictionary) + 1) + code) // (len(coded.dictionary) + 1)
    return total, total - np.bincount(distinct, minlength=n)


def count_texts(col: pa.Array, window: int = 5) -> np.ndarray:
    """The counts of each text of an Arrow column, a row for each text and a column for each of ``COUNTS``."""
    n = len(col)
    c = {name: np.zeros(n, np.int64) for name in COUNTS}
    c["n_lines"], c["n_dup_lines"] = duplicate_lines(col)
    for t in whole_texts(col):
        for b in t.blocks:
            heads = b.offsets[:-1]
            double = np.zeros(len(b.buf), bool)
            double[1:] = KINDS["sign"][b.buf[1:]] & (b.buf[1:] == b.buf[:-1])
            marks = {"word_chars": KINDS["head"][b.buf] & b.word, "n_symbols": KINDS["symbol"][b.buf], "n_upper": KINDS["upper"][b.buf], "n_lower": KINDS["lower"][b.buf], "n_digits": KINDS["digit"][b.buf], "n_signs": KINDS["sign"][b.buf], "n_doubled": double}
            for name, flags in marks.items():
                np.add.at(c[name], b.rows, np.add.reduceat(flags, heads, dtype=np.int64))
            signs = np.concatenate(([0], np.cumsum(marks["n_signs"])))
            bare = signs[b.ends] - signs[b.starts] == b.ends - b.starts
            np.add.at(c["n_bare"], b.rows[b.piece_of_word()], bare)
        size = np.diff(t.first)
        c["n_words"][t.rows] = size
        text = np.repeat(np.arange(len(t.rows)), size)
        own = mix(text.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))  # tells the texts of a batch apart
        echo = np.flatnonzero((t.hashes[1:] == t.hashes[:-1]) & (text[1:] == text[:-1]))
        c["n_echoes"][t.rows] = np.bincount(text[echo], minlength=len(t.rows))
        c["n_distinct"][t.rows] = np.bincount(text[np.unique(mix(t.hashes ^ own), return_index=True)[1]], minlength=len(t.rows))
        if len(t.hashes) >= window:
            at = np.arange(len(t.hashes) - window + 1)
            at = at[text[at] == text[at + window - 1]]
            at = at[_copies(mix(run_hashes(t.hashes, at, window) ^ own[at]))]
            cover = np.zeros(len(t.hashes) + 1, np.int64)
            cover[at] += 1
            np.subtract.at(cover, at + window, 1)
            c["n_repeat_words"][t.rows] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=len(t.rows))
    return np.stack([c[name] for name in COUNTS], axis=1) if n else np.zeros((0, len(COUNTS)), np.int64)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, one column for each of ``COUNTS``) for every row of ``docs``; ``row`` is a struct of the row's own columns.

    Words are separated by ASCII white space; letters, digits and signs are
    ASCII.  ``n_echoes``: words that equal the one before; ``n_repeat_words``: words in windows of five that the text holds
    twice or more; ``n_dup_lines``: lines with a word that equal an earlier
    one.  Null and empty texts count nothing; long texts are read whole;
    repeated rows are counted alike; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<" + ", ".join(f"{c}: long" for c in COUNTS) + ">")
    def of(col: pa.Array) -> pa.Array:
        got = count_texts(col)
        return pa.StructArray.from_arrays([pa.array(got[:, k]) for k in range(len(COUNTS))], list(COUNTS))

    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", of(F.col("row")[text_col].cast("string")).alias("c")).select("row", "c.*")


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


@dataclass
class Rule:
    """All of ``conditions`` (statistic, ">=" or "<", threshold) hold: ``label``."""

    conditions: list[tuple[str, str, float]]
    label: int
    covered: int = 0
    right: int = 0

    def sql(self) -> str:
        return " and ".join(f"({STATISTICS.get(s, s)}) {sign} {at!r}D" for s, sign, at in self.conditions) or "true"

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for s, sign, at in self.conditions:
            v = x[:, names.index(s)]
            ok &= v >= at if sign == ">=" else v < at
        return ok


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: int = 1

    def verdict(self) -> Column:
        """The label of the first rule that holds, as one conditional expression over the counts."""
        out = None
        for r in self.rules:
            out = F.when(F.expr(r.sql()), F.lit(r.label)) if out is None else out.when(F.expr(r.sql()), F.lit(r.label))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def predict(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out, left = np.full(len(x), self.default), np.ones(len(x), bool)
        for r in self.rules:
            hit = left & r.holds(x, names)
            out[hit], left[hit] = r.label, False
        return out


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold with the largest FOIL gain for the rows with ``y``; ties go to the earlier statistic, then the smaller threshold."""
    p0, n0 = y.sum(), (~y).sum()
    if not p0 or not n0:
        return 0.0, None
    before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, hit = x[order, k], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(cut):
            continue
        p = np.concatenate(([0], np.cumsum(hit)))[cut]
        low = {"<": (p, cut - p), ">=": (p0 - p, n0 - (cut - p))}
        at = (v[cut] + v[cut - 1]) / 2
        for sign, (pos, neg) in low.items():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pos > 0, pos * (np.log2(pos / (pos + neg)) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = float(gain[i]), (name, sign, float(at[i]))
    return best


def grow(x: np.ndarray, y: np.ndarray, names: list[str], label: int, most: int = 4) -> Rule:
    """Add the best threshold until the rule covers no row without ``y``, or ``most`` conditions."""
    rule, ok = Rule([], label), np.ones(len(x), bool)
    while len(rule.conditions) < most and (~y[ok]).any():
        _, condition = _best_condition(x[ok], y[ok], names)
        if condition is None:
            break
        rule.conditions.append(condition)
        ok = rule.holds(x, names)
    return rule


def prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """Take conditions off the end while (right - wrong) / covered on other rows doesn't fall."""
    best, worth = rule, -2.0
    for n in range(1, len(rule.conditions) + 1):
        short = Rule(rule.conditions[:n], rule.label)
        ok = short.holds(x, names)
        value = (2 * y[ok].mean() - 1) if ok.any() else -1.0
        if value > worth:
            best, worth = short, value
    return best


def learn(x: np.ndarray, y: np.ndarray, names: list[str], purity: float = 0.9, most_rules: int = 12) -> DecisionList:
    """Sequential covering: rules for the rarer classes first, the most frequent one by default.

    A third of the rows, every third in their order, prunes and judges a rule;
    a rule that is right in less than ``purity`` of those it covers, or covers
    none, ends its class.
    """
    classes, n = np.unique(y, return_counts=True)
    if not len(classes):
        return DecisionList()
    order = classes[np.lexsort((classes, n))].tolist()
    out, left = DecisionList(default=int(order[-1])), np.ones(len(y), bool)
    apart = np.arange(len(y)) % 3 == 2
    for label in order[:-1]:
        while len(out.rules) < most_rules:
            at = np.flatnonzero(left)
            own, judge = at[~apart[at]], at[apart[at]]
            if not (y[own] == label).any():
                break
            rule = grow(x[own], y[own] == label, names, int(label))
            rule = prune(rule, x[judge], y[judge] == label, names)
            hit = judge[rule.holds(x[judge], names)]
            if not rule.conditions or not len(hit) or (y[hit] == label).mean() < purity:
                break
            every = at[rule.holds(x[at], names)]
            rule.covered, rule.right = len(every), int((y[every] == label).sum())
            out.rules.append(rule)
            left[every] = False
    return out


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, purity: float = 0.9) -> DecisionList:
    """Learn from the counts of at most ``sample`` labelled rows, those with the smallest hashes of their ids.

    Held-out rows (crc32 of the id modulo 5 is 0), rows without label or id
    and texts that the base rules decide are not learned from; of several
    labels the lowest counts, and of rows that repeat an id one for each
    different set of statistics.  The rows are put in one order first, so the list doesn't depend
    on how they arrive.  Without rows the list is empty and keeps everything.
    """
    chosen = labels.select(F.col(id_col).alias("k"), F.col(target).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out("k"))
    chosen = chosen.groupBy("k").agg(F.min("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k")  # two integers a row
    counts = text_counts(own, "t").where(~base_failed())
    stats = [F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()]
    got = counts.select(F.col("row.k").alias("k"), F.col("row.y").alias("y"), *stats).groupBy("k", "y", *STATISTICS).count().orderBy(F.xxhash64("k"), "k", *STATISTICS).limit(sample).toPandas()
    return learn(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(int), list(STATISTICS), purity)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """(row, counts, base_failed, kept): the base rules first, then the first of ``rules`` that holds; label 1 is kept.

    What ``text_counts`` says of nulls, empty, long and repeated texts holds
    here too; texts of fewer than ten words, null ones included, fail.
    """
    counts = text_counts(docs, text_col).withColumn("base_failed", base_failed())
    return counts.withColumn("kept", ~F.col("base_failed") & (rules.verdict() == 1))
