"""Periodic runs, learned rules and the filter audit against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import audit, periodic, queries, rules, words

SF = "/root/testdata/sf0.001"


def split(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w: list, repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) by trying every period everywhere."""
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w: list[str], runs) -> str:
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(n: int = 150) -> list[str | None]:
    r = random.Random(11)
    out: list[str | None] = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "É É É É É É É", "x" * 5000]
    # the windows of one grid of period 15 all lie in runs of period 4
    out.append(" ".join("abcaabcaabcaabc" * 6))
    for _ in range(n):
        letters = r.choice([1, 2, 3, 9])
        w = [r.choice("abcdefghi"[:letters]) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4)):
            p = r.randrange(1, 14)
            block, at = [r.choice("abcdefghi"[:letters]) for _ in range(p)], r.randrange(len(w) + 1)
            w[at:at] = [block[i % p] for i in range(r.randrange(3 * p, 7 * p))]
        out.append(r.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Long texts come in pieces of 64 bytes."""
    whole = words.blocks
    monkeypatch.setattr(words, "blocks", lambda col, table=words.SPACE: whole(col, table, limit=64))


def test_runs_in_batches(monkeypatch):
    texts = [split(t) for t in periodic_texts()]
    first = np.cumsum([0, *map(len, texts)])
    code = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    flat = np.array([code[w] for t in texts for w in t], np.uint64)
    for points in (1 << 19, 17):
        monkeypatch.setattr(periodic, "POINTS", points)
        got = collections.defaultdict(list)
        for s, e, p in zip(*(a.tolist() for a in periodic.find_runs(flat, first)), strict=True):
            t = int(np.searchsorted(first, s, "right")) - 1
            got[t].append((s - int(first[t]), e - s, p))
        assert [got[t] for t in range(len(texts))] == [brute_runs(t) for t in texts]


def test_runs_of_long_texts():
    for n, period in ((200_000, 1), (200_000, 7), (200_000, 49_999)):
        s, e, p = periodic.find_runs(np.arange(n, dtype=np.uint64) % np.uint64(period), np.array([0, n]))
        assert (s.tolist(), e.tolist(), p.tolist()) == ([0], [n], [period])


def test_collapse_runs(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(periodic_texts())]
    rows += [rows[20], (None, rows[21][1], None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string, runs int")
    got = periodic.collapse_runs(docs).select("row.doc_id", "row.text", "row.runs", "n_words", F.col("runs").alias("found"), "collapsed").collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None) == sorted((x[0], x[1]) for x in rows if x[0] is not None) or len(got) == len(rows)
    for x in got:
        w = split(x.text)
        assert x.n_words == len(w)
        assert [(r.start, r.length, r.period) for r in x.found] == brute_runs(w)
        assert x.collapsed == brute_collapsed(w, brute_runs(w))
    assert periodic.collapse_runs(spark.createDataFrame([], docs.schema)).count() == 0


def test_pieces_of_long_texts(small_blocks):
    col = pa.array(periodic_texts())
    for t in words.whole_texts(col):
        every = [split(col[int(r)].as_py()) for r in t.rows]
        assert np.diff(t.first).tolist() == [len(w) for w in every]
        keep = np.arange(len(t.hashes)) % 3 > 0
        want = [" ".join(w for i, w in enumerate(ws) if keep[t.first[k] + i]) for k, ws in enumerate(every)]
        assert periodic.kept_text(t, keep) == want
        flat = [w for ws in every for w in ws]
        assert len(set(zip(flat, t.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(t.hashes.tolist()))


def test_op11_tails(spark):
    """The query against brute force on the tables, tails included."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        w = split(text)
        g, tail = divmod(zlib.crc32(str(d).encode()), 10)
        if not tail and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        if len(w) > 1500:
            continue  # the plain way is quadratic
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert got[d].n_runs == len(runs)
        assert (got[d].start, got[d].length, got[d].period) == (best or (None,) * 3)
        assert got[d].exponent_milli == (best and 1000 * best[1] // best[2])
        assert got[d].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert got[d].collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()


def brute_counts(text: str | None) -> dict[str, int]:
    text = text or ""
    w = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    raw = text.encode()
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_digits": len(re.findall("[0-9]", text)), "n_signs": sum(b in signs for b in raw), "n_doubled": sum(a == b and a in signs for a, b in zip(raw, raw[1:], strict=False)),
        "n_bare": sum(all(ord(c) in signs for c in x) for x in w), "n_echoes": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_distinct": len(set(w)),
    }


def counted_texts() -> list[str | None]:
    r = random.Random(5)
    out = [*periodic_texts(40), "A\nA\nA", "a  \na\n a\n\n\n", "## ** $$ ab !!x ||", "é É ß ñ\n\x1c é", "<a> <a> & b\r\nb\r\nb", "word " * 9, "one two three four five " * 30 + "end", "\n".join("same line here" for _ in range(40))]
    out.append(" ".join(r.choice("abcdef") + r.choice("ABC#|!9") * r.randrange(3) for _ in range(400)))
    return out


def check_counts(col: pa.Array):
    got = rules.count_texts(col)
    for row, text in zip(got.tolist(), col.to_pylist(), strict=True):
        assert dict(zip(rules.COUNTS, row, strict=True)) == brute_counts(text), text


def test_counts():
    check_counts(pa.array(counted_texts()))
    check_counts(pa.array([], pa.string()))


def test_counts_in_pieces(small_blocks):
    check_counts(pa.array(counted_texts()))


def test_grow_and_prune():
    r = np.random.default_rng(2)
    x = r.random((3000, 3))
    y = np.where((x[:, 0] > 0.7) & (x[:, 1] < 0.4), 0, 1)
    noisy = np.where(r.random(3000) < 0.02, 1 - y, y)
    got = rules.learn(x, noisy, ["a", "b", "c"], purity=0.8)
    assert got.default == 1 and got.rules and {s for q in got.rules for s, _, _ in q.conditions} >= {"a", "b"}
    fresh = r.random((2000, 3))
    truth = np.where((fresh[:, 0] > 0.7) & (fresh[:, 1] < 0.4), 0, 1)
    assert (got.predict(fresh, ["a", "b", "c"]) == truth).mean() > 0.97
    # conditions that only fit noise of the rows a rule was grown on are pruned
    assert all(len(q.conditions) <= 4 and q.right / q.covered >= 0.8 for q in got.rules)
    long = rules.Rule([("a", ">=", 0.7), ("b", "<", 0.4), ("c", ">=", 0.99)], 0)
    assert rules.prune(long, x, y == 0, ["a", "b", "c"]).conditions == long.conditions[:2]


def test_more_than_two_classes_and_order():
    r = np.random.default_rng(3)
    x = r.random((4000, 2))
    y = np.where(x[:, 0] < 0.1, 7, np.where(x[:, 1] < 0.3, 3, 5))
    got = rules.learn(x, y, ["a", "b"])
    assert [q.label for q in got.rules][0] == 7 and got.default == 5
    assert (got.predict(x, ["a", "b"]) == y).mean() > 0.98
    assert rules.learn(np.zeros((0, 2)), np.zeros(0, int), ["a", "b"]) == rules.DecisionList()
    assert rules.learn(np.zeros((9, 2)), np.array([0, 1] * 4 + [1]), ["a", "b"]).rules == []  # nothing tells the classes apart


def test_verdict_is_the_list(spark):
    """The conditional expression decides as the list does, the first rule first."""
    first = rules.DecisionList([rules.Rule([("symbol_share", ">=", 0.5)], 0), rules.Rule([("words", "<", 20.0), ("mean_word", ">=", 2.0)], 1), rules.Rule([("upper_share", ">=", 0.3)], 0)], 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(counted_texts())], "doc_id long, text string, kept string")
    got = rules.judge(docs, first).withColumn("label", first.verdict()).collect()
    for r in got:
        c = brute_counts(r.row.text)
        n = max(c["n_words"], 1)
        if c["n_symbols"] / n >= 0.5:
            want = 0
        elif c["n_words"] < 20 and c["word_chars"] / n >= 2.0:
            want = 1
        else:
            want = 0 if c["n_upper"] / max(c["n_upper"] + c["n_lower"], 1) >= 0.3 else 1
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        assert (r.label, r.base_failed, r.kept) == (want, failed, bool(want) and not failed)
    assert "CASE WHEN" in rules.judge(docs, first)._jdf.queryExecution().optimizedPlan().toString()


def test_op12_held_out(spark):
    """Junk goes and clean documents stay, on rows that weren't learned from."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op12_rules(spark, sf).select("doc_id", "base_failed", "kept").collect() if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    tried = [r for r in got if not r.base_failed]
    good, bad = [r for r in tried if labels[r.doc_id] == 1], [r for r in tried if labels[r.doc_id] == 0]
    assert len(bad) > 40 and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_on_rough_tables(spark):
    docs = spark.createDataFrame([(i, t, 1.0, "k") for i, t in enumerate(counted_texts())] + [(1, "again " * 30, None, None), (None, "x " * 12, None, None)], "doc_id long, text string, y double, k string")
    labels = spark.createDataFrame([(i, i % 2, 0, "l") for i in range(40)] + [(3, None, None, None), (None, 1, 0, None), (4, 0, 1, "m")], "doc_id long, quality int, toxic int, text string")
    assert rules.judge(docs, rules.fit(docs, labels)).count() == docs.count()
    none = spark.createDataFrame([], docs.schema)
    assert rules.judge(none, rules.fit(none, labels)).count() == 0
    free = rules.fit(docs, labels.limit(0))
    assert free.rules == [] and {(r.base_failed, r.kept) for r in rules.judge(docs, free).collect()} == {(True, False), (False, True)}
    assert rules.fit(docs.repartition(5), labels) == rules.fit(docs, labels)


FAILS = {
    "A": lambda t, w: len(w) < 50,
    "B": lambda t, w: 100 * len(set(w)) < 65 * len(w),
    "C": lambda t, w: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
    "D": lambda t, w: re.search("[#$%&*|]", t) is not None,
}


def brute_audit(docs, labels):
    low, good, toxic = {}, set(), set()
    for d, t, _ in docs:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    parts = collections.defaultdict(list)
    for d, t, s in docs:
        t, fails = t or "", set()
        for k, f in FAILS.items():
            fails |= {k} if f(t, split(t)) else set()
        fails |= {"E"} if d is not None and d > low[t] else set()
        parts[s or ""].append((fails, d is not None and d in good, d is not None and d in toxic))
    out, shapley = {}, collections.Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[0]]
                left = [r for r in left if k not in r[0]]
                shapley[part, k] += len(gone)
                failing = sum(k in r[0] for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {k} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited_rows():
    r = random.Random(8)
    texts = [None, "", "Ab", "AB #", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 9}" for i in range(60)), " ".join(f"W{i % 9}" for i in range(70)), "A" * 400 + " x" * 60, "| " * 80, "É " * 55, "q" * 30_000]
    docs = [(i, r.choice(texts), r.choice(["s1", "s2", None, "", "s3"])) for i in range(150)]
    docs += [docs[7], docs[7], (None, texts[4], "s1"), (None, texts[4], "s2"), (None, "only here", "s1")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(100)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit(spark):
    rows, marks = audited_rows()
    docs = spark.createDataFrame([(d, t, s, "m", 1) for d, t, s in rows], "doc_id long, text string, source string, mask string, n int").repartition(5)
    labels = spark.createDataFrame([(*x, "t") for x in marks], "doc_id long, quality int, toxic int, text string")
    marked = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    counts = audit.mask_counts(audit.text_masks(docs), labels, marked=marked)
    got = audit.audit(counts, "ABCDE", ("good", "toxic"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == brute_audit(rows, marks)
    assert got.count() == 600 * len({s or "" for _, _, s in rows})
    empty = spark.createDataFrame([], docs.schema)
    assert audit.audit(audit.mask_counts(audit.text_masks(empty), labels, marked=marked), "ABCDE", ("good", "toxic")).count() == 0
    assert audit.mask_counts(audit.text_masks(docs), labels.limit(0), marked=marked).agg(F.sum("n"), F.sum("good")).first() == (len(rows), 0)


def test_zeta_of_other_filters(spark):
    """Three filters, no labels: the transform against the sums over subsets."""
    r = random.Random(1)
    c = {m: r.randrange(50) for m in range(8)}
    counts = spark.createDataFrame([("p", m, n) for m, n in c.items() if n], "part string, mask int, n long")
    got = {(x.filter_order, x.step): x for x in audit.audit(counts, "XYZ").collect()}
    assert len(got) == 18
    for order in itertools.permutations(range(3)):
        name, gone = "".join("XYZ"[k] for k in order), 0
        for step, k in enumerate(order, 1):
            x = got[name, step]
            kept = sum(n for m, n in c.items() if not m & (gone | 1 << k))
            assert (x.kept, x.removed) == (kept, sum(n for m, n in c.items() if m >> k & 1 and not m & gone))
            assert x.unique_fails == c[1 << k] and x.redundant == sum(n for m, n in c.items() if m >> k & 1 and m & gone)
            gone |= 1 << k
    assert all(x.shapley == sum(y.removed for y in got.values() if y.filter_order[y.step - 1] == x.filter_order[x.step - 1]) for x in got.values())
