"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import collections
import gzip
import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspan.llm import bpe, chat, decontam, embed, quality, queries, shards, simhash, similar, substring, toxicity, warc, words
from quillspan.llm.components import components
from quillspan.llm.scratch import Scratch
from quillspan.llm.xxh64 import xxh64_runs

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, score double, row string"


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randrange(1, 160))) for _ in range(n)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    base += [b + "\n" + passage for b in base[:8]] + base[:4] + ["", "  \t", None, None, "A b", "É " * 300, "x" * 3000]
    return base


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.5, "r") for i, t in enumerate(texts())]
    rows += [rows[3], (None, rows[5][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_pieces_agree():
    col = pa.array(texts())
    for lower in (False, True):
        whole, parts = collections.Counter(), collections.Counter()
        for out, limit in ((whole, 1 << 20), (parts, 97)):
            for b in words.blocks(col, words.SPACE, lower=lower, margin=3, limit=limit):
                h = b.word_hashes()
                for p, row in enumerate(b.rows.tolist()):
                    for i in range(b.own_from[p], b.own_to[p]):
                        out[row, int(i - b.first[p] + b.base[p]), int(h[i])] += 1
        assert whole == parts and max(whole.values()) == 1
        assert len(whole) == sum(len((t or "").encode().split()) for t in texts())


def test_xxh64():
    r = random.Random(4)
    buf = np.frombuffer(bytes(r.randrange(256) for _ in range(5000)), np.uint8)
    start = np.array([r.randrange(4000) for _ in range(3000)])
    size = np.array([r.randrange(0, 220) for _ in range(3000)])
    got = xxh64_runs(buf, start, size, 42)
    assert all(int(g) == xxhash.xxh64_intdigest(buf[s : s + n].tobytes(), 42) for g, s, n in zip(got, start, size, strict=True))


def brute_fingerprint(text: str | None, k: int = 4) -> int:
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_holds():
    r = random.Random(9)
    for radius, seed in ((4, 0), (4, 5)):
        ms = [m & (1 << 64) - 1 for m in simhash.masks(radius, seed)]
        assert len(ms) == 31
        for _ in range(3000):
            diff = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not diff & m for m in ms)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash(spark, docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)  # small: every bucket takes the second covering
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, fps[i], low.get(find(i))) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def shingle_set(text: str | None, k: int = 5) -> set:
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_similar(rows, least: float = 0.8) -> dict:
    """The smallest id reachable from each id over exact Jaccard similarities."""
    parent, sets = {d: d for d, _ in rows}, [(d, shingle_set(t)) for d, t in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if min(len(s), len(t)) >= least * max(len(s), len(t)) and len(s & t) >= least * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def near_texts() -> list:
    """Chains and stars of edited copies around the threshold."""
    r = random.Random(12)
    out = []
    for _ in range(25):
        ws = [f"v{r.randrange(5000)}" for _ in range(r.randrange(5, 300))]
        for _ in range(8):
            out.append(" ".join(ws))
            if r.random() < 0.7:
                ws = list(ws)
            for _ in range(r.randrange(0, 1 + len(ws) // 40)):
                ws[r.randrange(len(ws))] = f"v{r.randrange(5000)}"
    r.shuffle(out)
    return out


def test_similar_documents(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    rows += [(1000 + i, t) for i, t in enumerate(near_texts())]
    df = spark.createDataFrame([(*x, "clash", 1.0) for x in rows], "doc_id long, text string, component string, fp double").repartition(3)
    got = {r.id: r.component for r in similar.similar_documents(df).collect()}
    assert got == brute_similar(rows)
    null = similar.similar_documents(docs).where("id is null").collect()
    assert len(null) == 2 and all(r.component is None for r in null)
    assert similar.similar_documents(empty).count() == 0


def template_texts(pairs: int = 150) -> list[str]:
    """One template; planted pairs a little above 0.8 within and below it between."""
    r = random.Random(8)
    template = [f"t{i}" for i in range(300)]
    out = []
    for p in range(pairs):
        own = [f"p{p}_{i}" for i in range(10)]
        for half in range(2):
            out.append(" ".join([*template, *own, *(f"h{p}_{half}_{i}" for i in range(32))]))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("block", "hot", "rounds"), [(4096, 64, 3), (40, 2, 3), (7, 1, 0)])
def test_similar_template(spark, block, hot, rounds, monkeypatch):
    """Pairs in a bucket that a template holds together, most members of which are below the threshold to any pivot."""
    for name, value in (("BLOCK", block), ("HOT", hot), ("ROUNDS", rounds)):
        monkeypatch.setattr(similar, name, value)
    rows = list(enumerate(template_texts()))
    want = brute_similar(rows)
    assert len(set(want.values())) == 150
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.component for r in similar.similar_documents(df).collect()} == want


def test_similar_dense_fingerprints(spark):
    """Short texts on one pattern: fingerprints of few bits' difference, pairs on both sides of the threshold."""
    r = random.Random(5)
    rows = []
    for i in range(300):
        ws = [f"b{j}" for j in range(60)]
        for _ in range(r.randrange(0, 4)):
            ws[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    for i in range(300, 600):
        rows.append((i, " ".join(["k l m n o p q", r.choice("abc"), r.choice("abcdefgh"), r.choice("abcdefgh")])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.component for r in similar.similar_documents(df).collect()} == brute_similar(rows)


def test_distinct_shingles_in_pieces(monkeypatch):
    """A text that comes in many pieces has the same shingles and the same fingerprint."""
    t = [*texts(), *near_texts()]
    col, whole = pa.array(t), words.blocks

    def sketch():
        ones, total = np.zeros((len(t), 64), np.int64), np.zeros(len(t), np.int64)
        return [(row, h.tolist()) for row, h in similar._distinct(col, 5, 42, ones, total)], simhash.majority(ones, total).tolist()

    plain = sketch()
    monkeypatch.setattr(simhash, "blocks", lambda *a, **k: whole(*a, **k, limit=97))
    assert sketch() == plain
    assert [(i, len(x)) for i, x in enumerate(map(shingle_set, t)) if x] == [(row, len(h)) for row, h in plain[0]]


def test_dense_fingerprints(spark):
    """A hot group of near fingerprints, found by brute force too."""
    r = random.Random(3)
    base = r.getrandbits(63)
    fps = {base} | {base ^ sum(1 << b for b in r.sample(range(63), r.randrange(1, 9))) for _ in range(400)} | {r.getrandbits(63) for _ in range(100)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    s = Scratch(spark, "t")
    got = {r.node: r.root for r in components(simhash.links(df, s), s).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(find(f) == got.get(f, f) for f in fps)


def brute_kept(rows, w=35):
    split = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(ws[i : i + w]) for ws in split for i in range(len(ws) - w + 1))
    out = []
    for (d, _), ws in zip(rows, split, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if seen[tuple(ws[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((d, len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_substring(docs, empty, limit, monkeypatch):
    whole = words.blocks
    monkeypatch.setattr(substring, "blocks", lambda *a, **k: whole(*a, **{**k, "limit": limit}))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = substring.remove_repeats(docs)
    assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == brute_kept(rows)
    assert substring.remove_repeats(empty).count() == 0


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_colliding_words(spark):
    """Strings of 1024 and more bytes that collide under every polynomial hash modulo 2^64 with an odd base are different words."""
    for n in (1024, 2048, 4096):
        one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
        h = next(words.blocks(pa.array([f"{one} {two}"]))).word_hashes()
        assert h[0] != h[1]
        common = " ".join(f"c{i}" for i in range(34))
        df = spark.createDataFrame([(1, f"{common} {one}"), (2, f"{common} {two}"), (3, f"{common} {one} more")], "doc_id long, text string")
        assert sorted((r.row.doc_id, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(1, 35), (2, 0), (3, 35)]


def test_substring_periodic(spark):
    """Documents that repeat themselves and each other, a very common passage, and columns named like this operator's own."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(["x y"] * r.randrange(10, 120) + [f"u{i}"] * r.randrange(0, 60)) + f" {passage} tail{i % 3}", "g", 1, [1]) for i in range(40)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, h string, id int, spans array<int>").repartition(3)
    got = substring.remove_repeats(df).collect()
    assert sorted(((x.row.doc_id, x.n_words, x.n_removed, x.kept) for x in got), key=str) == brute_kept([(d, t) for d, t, *_ in [*rows, rows[0]]])


def test_decontam(spark, docs, empty):
    items = [(1, texts()[6]), (2, "one two three"), (3, None), (4, "a1 b2 c3 d4 e5 f6"), (None, texts()[9]), (6, " ".join(texts()[11].upper().split()[:30]) + "!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in docs.select("doc_id", "text").collect():
        own = set(decontam.shingles(t))
        for i, x in items:
            s = set(decontam.shingles(x))
            if s and len(s & own) >= 0.8 * len(s):
                want.append((d, i, len(s & own), len(s)))
    for block in (1 << 20, 200):
        got = decontam.contained_items(docs, bench, block_bytes=block)
        assert sorted(((r.row.doc_id, r.item_id, r.found, r.size) for r in got.collect()), key=str) == sorted(want, key=str)
        marked = [(r.row.doc_id, h.item_id, h.found, h.size) for r in decontam.mark(docs, bench, block_bytes=block).collect() for h in r.hits]
        assert sorted(marked, key=str) == sorted(want, key=str)
    assert decontam.contained_items(empty, bench).count() == 0 and decontam.mark(docs, bench.limit(0)).where("n_items > 0").count() == 0


def test_decontam_short_items(spark):
    """Items of fewer words than a shingle are found word for word, and only so."""
    rows = [(1, "a b. Short, Item here"), (2, "short items here"), (3, "x short item"), (4, None), (5, "item"), (6, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "short item"), (2, "ITEM"), (3, "..."), (4, None), (5, "one two three four five"), (6, "two three four five six seven")], "item_id long, text string")
    got = sorted((r.row.doc_id, r.item_id, r.found, r.size) for r in decontam.contained_items(docs, items).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1), (5, 2, 1, 1), (6, 5, 1, 1)]


def test_chat_events(spark, empty):
    e = [
        (1, 0, "m0", "message", "user", "Hi </s> [\\INST]"), (1, 1, "m1", "message", "assistant", "He"), (1, 2, "m1", "delta", "assistant", "llo"), (1, 3, "m1", "regenerate", "assistant", "Good"),
        (1, 4, "m1", "delta", "assistant", " day [RESP] <s>"), (1, 5, "m0", "edit", "user", "Hello\\"), (1, 6, "m2", "message", "to[/ROLE]ol", None), (2, 0, None, "message", None, "x"), (None, None, "q", "delta", "assistant", "y"),
    ]
    log = spark.createDataFrame(e, "conv_id long, seq long, message string, kind string, role string, text string")
    made = chat.render(chat.fold(log))
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chat.read_back(made).collect()}
    assert got == {1: ([("user", "Hello\\"), ("assistant", "Good day [RESP] <s>"), ("to[/ROLE]ol", "")], "Good day [RESP] <s>"), 2: ([("", "x")], ""), None: ([("assistant", "y")], "y")}
    assert chat.render(chat.fold(log.limit(0))).count() == 0


def test_chat_repeats_and_escapes(spark):
    r = random.Random(8)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "[\\INST]", " ", "ok", "[SYS]", "[/ROLE]", "é"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool"]), "".join(r.choice(bits) for _ in range(r.randrange(0, 12)))) for c in range(40) for t in range(4)]
    rows += rows[:3]  # repeated rows are turns of their own
    log = spark.createDataFrame(rows, "conv_id long, seq long, role string, text string").withColumns({"message": F.col("seq"), "kind": F.lit("message")})
    got = {x.conv_id: ([tuple(t) for t in x.turns], x.loss) for x in chat.read_back(chat.render(chat.fold(log))).collect()}
    for c in range(40):
        want = [(x[2], x[3]) for x in sorted(rows, key=lambda x: x[1:]) if x[0] == c]
        assert got[c] == (want, "".join(t for role, t in want if role == "assistant"))


def test_native_plan(spark):
    plan = queries.op1_chat(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_warc(spark):
    body = "z" * 200
    rows = [(3, "http://a/\r\nX: y", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "n", body), (1, "again", body), (6, "u", "é" * 80)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    scratch = Scratch(spark, "w")
    m = warc.write(pages, f"{scratch.path}/a", scratch, roll_bytes=400)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(m, f"{scratch.path}/a").collect()), key=str)
    want = []
    for i, (p, _, h) in enumerate(rows):
        data = (h or "").encode()
        first = p == 1 and i == 1
        revisit = data == body.encode() and not first
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert got == sorted(want, key=str)
    again = warc.write(pages.repartition(5), f"{scratch.path}/b", scratch, roll_bytes=400)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))  # the same bytes
    path = f"{scratch.path}/a/".removeprefix("file://") + sorted(r.file for r in m.collect())[0]
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_references(spark):
    """A revisit names the record that holds its payload, also where page ids repeat with other payloads."""
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(1, "u", a), (1, "v", b), (1, "w", c), (1, "x", b), (2, "u", b), (2, "v", a), (3, "u", c), (3, "u", c), (4, "u", "short"), (4, "u", "short")]
    scratch = Scratch(spark, "w")
    m = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{scratch.path}/a", scratch, roll_bytes=300)
    heads, bodies = [], {}
    for r in m.collect():
        with gzip.open(f"{scratch.path}/a/{r.file}".removeprefix("file://")) as f:
            for part in f.read().split(b"WARC/1.1\r\n")[1:]:
                head, body = warc.parse(b"WARC/1.1\r\n" + part)
                heads.append(head)
                bodies[head["WARC-Record-ID"]] = (head["WARC-Type"], body)
    assert len(bodies) == len(heads) == len(rows)  # no name twice
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 5
    for h in revisits:
        kind, body = bodies[h["WARC-Refers-To"]]
        assert kind == "response" and f"sha256:{hashlib.sha256(body).hexdigest()}" == h["WARC-Payload-Digest"]


@pytest.mark.parametrize("block", [embed.BLOCK, 7])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", block)  # small: leaves and components are dealt into cells
    r = np.random.default_rng(6)
    base = r.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] + r.normal(scale=0.04, size=8)], i % 3) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 8, 0), (304, [float("nan")] * 8, 0), (305, [1.0, None], 0), (306, rows[0][1], None), (307, [], 1), (308, [1.0], 0), (None, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.98} for i in good}
    got = {x.id: x for x in embed.near_vectors(df, leaf=16).collect()}
    assert len(got) == len(rows)
    found, total = sum(got[i].n_links for i in good), sum(map(len, links.values()))
    assert 0.95 * total <= found <= total and total > 300
    exact = {x.id: x for x in embed.near_vectors(df, leaf=10_000).collect()}  # one leaf for each label: exact
    for i in good:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (exact[i].n_links, exact[i].component, exact[i].kept) == (len(links[i]), min(seen), min(seen) == i)
    assert all(got[i].n_links == 0 and got[i].component == i and got[i].kept for i in (302, 303, 304, 305, 306, 307))
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_forest_recall_beyond_the_sample(spark):
    """A first sample far too small for its leaves: they are split in the executors, and the pairs are still found."""
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 16))
    near = v + r.normal(scale=0.03, size=v.shape) * np.linalg.norm(v, axis=1, keepdims=True) / 4
    both = np.concatenate((v, near))
    unit = both / np.linalg.norm(both, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.98
    want = links.sum(1) - 1
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(both)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {x.id: x.n_links for x in embed.near_vectors(df, leaf=32, sample=200).collect()}
    found = sum(got.values())
    assert want.sum() > 2000 and 0.95 * want.sum() <= found <= want.sum() and all(got[i] <= want[i] for i in got)
    # leaves that the first trees leave too large are gone
    nodes = df.select("label", F.lit(16).cast("long").alias("dim"), F.col("vec_id").alias("node"), F.col("embedding").alias("vec"), F.lit(0).cast("long").alias("leaf")).withColumn("label", F.col("label").cast("long"))
    split, _ = embed.split_leaves(nodes, 32, Scratch(spark, "e"))
    sizes = [x[0] for x in split.groupBy("leaf").count().select("count").collect()]
    assert {x.node for x in split.select("node").distinct().collect()} == set(range(3000)) and max(sizes) < 120 and len(sizes) > 60


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x.node: x.root for x in components(df, Scratch(spark, "c")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(got.get(x, x) == find(x) for x in parent)


def test_quality_held_out(spark, docs, empty):
    rows = queries.op7_quality(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert len(held) > 40 and sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int"), "quality")
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    none = quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"), "quality")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def plain_features(text: str, buckets: int = 64) -> list[float]:
    """The features of one short text, by Python's strings and whole numbers."""
    data, words_ = text.encode() + b"\n", text.encode().split()
    full = (1 << 64) - 1

    def mixed(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return h ^ h >> 31

    def hashed(w):
        if len(w) > 16:
            return xxhash.xxh64_intdigest(w, 0x5EED)
        low, high = int.from_bytes(w[:8], "little"), int.from_bytes(w[8:], "little")
        return mixed(mixed(low + len(w) * 0xA24BAED4963EE407 & full) + high * 0x9FB21C651E98DF25 & full)

    sign = lambda b: 33 <= b < 127 and not chr(b).isalnum()
    upper, lower, digit, signs, line, beyond = (sum(f(b) for b in data) for f in (lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, sign, lambda b: b == 10, lambda b: b >= 128))
    count = np.zeros(buckets)
    for w in words_:
        count[hashed(w) % buckets] += 1
    n, total = max(len(words_), 1), len(data)
    more = [sum(a == b for a, b in zip(words_, words_[1:], strict=False)), sum(any(map(sign, w)) for w in words_), sum(map(len, words_)) / 10, sum(a == b and sign(a) for a, b in zip(data, data[1:], strict=False)), sum(all(map(sign, w)) for w in words_), sum(len(w) > 20 for w in words_)]
    stats = [upper / max(upper + lower, 1), digit / total, signs / total, line / n, beyond / total, *(x / n for x in more), (count > 0).sum() / min(n, buckets), count.max() / n, np.log1p(len(words_)) / 5, float(not words_), np.log1p(total) / 8]
    v = np.log1p(count)
    return [*(v / max(np.sqrt((v**2).sum()), 1e-9)), *stats]


def test_quality_features_and_scores_by_hand(spark):
    t = ["", "  ", "A b b 12 -- x!!", "É ünï " * 5, "w" * 30 + " w" * 9 + "\n\n(a)", *[x for x in texts()[:20] if x]]
    want = np.array([plain_features(x) for x in t])
    assert np.allclose(quality.features(pa.array(t), 64), want, atol=1e-5)
    r = np.random.default_rng(3)
    size = want.shape[1]
    m = quality.FactorisationMachine(0.1, r.normal(size=size), r.normal(size=(size, 3)), np.full(size, 0.1), np.full(size, 1.5))
    x = np.clip((want - 0.1) * 1.5, -6, 6)
    slow = [0.1 + v @ m.weights + sum(m.factors[i] @ m.factors[j] * v[i] * v[j] for i in range(size) for j in range(i)) for v in x]
    df = spark.createDataFrame([*enumerate(t), (99, None), (2, t[2])], "score long, text string")  # a clashing name, a null, a repeated row
    got = {(s.row.score, s.row.text): s.score for s in quality.score(df, m, buckets=64).collect()}
    assert np.allclose([got[i, x] for i, x in enumerate(t)], 1 / (1 + np.exp(-np.clip(slow, -35, 35))), atol=1e-4) and got[99, None] == got[0, ""]


def test_toxicity_scores_by_hand(spark):
    """The cumulative link from distinct words, also of a text longer than a block, and ties between grades."""
    vocab = [b"bad", b"worse", b"fine"]
    block = next(words.blocks(pa.array(["bad worse fine"]), words.PUNCT, lower=True))
    hashes = block.word_hashes()
    order = np.argsort(hashes)
    sieve = np.zeros(1 << 16, bool)
    sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    weight = {b"bad": 1.0, b"worse": 2.0, b"fine": -1.0}
    m = toxicity.OrdinalModel(hashes[order], np.array([weight[vocab[k]] for k in order]), np.array([0.5, 1.5]), sieve)
    long = ("fine BAD, " + "x " * 2000) * 80
    assert len(long) > words.BLOCK
    t = ["bad", "Bad! bad worse", "", "fine", "nothing", long]
    df = spark.createDataFrame([*enumerate(t), (9, None), (0, "bad")], "grade long, text string")
    got = {(r.row.grade, r.row.text): r for r in toxicity.score(df, m).collect()}
    for i, x in enumerate(t):
        eta = sum(weight[w] for w in set(x.lower().replace("!", " ").replace(",", " ").encode().split()) & set(weight))
        above = 1 / (1 + np.exp(-(eta - np.array([0.5, 1.5]))))
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert np.isclose(got[i, x].severity, above.sum()) and np.isclose(got[i, x].p_toxic, above[0]) and got[i, x].grade == int(np.argmax(each))
    assert got[9, None].severity == got[2, ""].severity
    row, h = toxicity.distinct_words(pa.array(t))
    assert len({*zip(row.tolist(), h.tolist(), strict=True)}) == len(row) == 1 + 2 + 0 + 1 + 1 + 3


def test_toxicity_held_out(spark):
    """Fitted on one half of the labelled rows, measured on the other."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = toxicity.score(docs.where(~half), toxicity.fit(docs, labels.where(half))).select("row.doc_id", "p_toxic").join(labels, "doc_id").collect()
    bad, good = ([r for r in got if r.toxic == v] for v in (1, 0))
    assert len(bad) > 20 and sum(r.p_toxic >= 0.5 for r in bad) >= 0.85 * len(bad) and sum(r.p_toxic >= 0.5 for r in good) <= 0.01 * len(good)


def test_pairwise_identity():
    r = np.random.default_rng(0)
    m = quality.FactorisationMachine(0.1, r.normal(size=7), r.normal(size=(7, 3)), np.zeros(7), np.ones(7))
    x = r.normal(size=(5, 7)).clip(-5, 5)
    slow = [0.1 + v @ m.weights + sum(m.factors[i] @ m.factors[j] * v[i] * v[j] for i in range(7) for j in range(i)) for v in x]
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-np.array(slow))))


def test_toxicity(spark, docs, empty):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    bad = [r for r in rows if label.get(r.doc_id) == 1]
    good = [r for r in rows if label.get(r.doc_id) == 0]
    assert sum(r.toxic for r in bad) >= 0.88 * len(bad) and sum(r.toxic for r in good) <= 0.01 * len(good)
    graded = spark.createDataFrame([(i, i % 4) for i in range(40)], "doc_id long, toxic int")
    m = toxicity.fit(docs, graded, graded=True)
    assert len(m.thresholds) == 3 and (np.diff(m.thresholds) > 0).all()
    got = toxicity.score(docs, m).collect()
    assert len(got) == docs.count() and all(0 <= r.severity <= 3 for r in got)
    assert toxicity.score(empty, m).count() == 0 and toxicity.score(docs, toxicity.fit(empty, graded.limit(0))).count() == docs.count()


def test_shards(spark, docs, empty):
    docs = docs.withColumn("_shard", F.lit("own"))
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "lang", "score", "row", "_shard").collect()))
    for arrivals in (1, 4):
        store, back = shards.shard_table(docs, target=20_000, arrivals=arrivals)
        assert key(back) == key(docs) and back.columns[-1] == "__shard"
    v = store.version()
    for _ in range(5):
        store.append(docs.limit(2))
    n = len(store.manifest())
    store.compact()
    assert len(store.manifest()) < n and store.read(docs.schema).count() == docs.count() + 10
    assert store.read(docs.schema, v).count() == docs.count()  # older versions stay readable until vacuum
    before = store.manifest(v)
    with pytest.raises(RuntimeError):
        store.commit(v - 1, [])
    assert store.manifest(v) == before  # the second writer replaced nothing
    assert shards.shard_table(empty)[1].count() == 0 and shards.shard_table(empty, arrivals=3)[1].count() == 0


def test_shards_left_over_move_up(spark):
    """Tiers of three shards each are merged together; fewer than four small shards stay."""
    store = shards.ShardStore(spark, f"{Scratch(spark, 's').path}", target=1 << 20)
    own = [{"file": f"f{t}-{k}", "bytes": 1000 * 4**t + k, "tier": store.tier(1000 * 4**t + k)} for t in range(5) for k in range(3)]
    assert len({s["tier"] for s in own}) == 5
    left, n = own, 0
    while bins := store.plan(left):
        gone = {s["file"] for b in bins for s in b}
        assert len(gone) == sum(map(len, bins)) and all(sum(s["bytes"] for s in b) <= store.target for b in bins)
        left = [s for s in left if s["file"] not in gone]
        for b in bins:
            n += 1
            size = sum(s["bytes"] for s in b)
            left.append({"file": f"m{n}", "bytes": size, "tier": store.tier(size)})
    assert n and len([s for s in left if s["bytes"] < store.target // 2]) < store.runs
    assert sum(s["bytes"] for s in left) == sum(s["bytes"] for s in own)
    assert store.plan(own[:3]) == [] and store.plan([]) == []


def test_shards_second_writer_between(spark, docs, monkeypatch):
    """A writer that commits the same version after the check and before the rename isn't replaced."""
    store, _ = shards.shard_table(docs, target=20_000)
    base, publish = store.version(), shards.ShardStore._publish

    def late(self, tmp, final):
        monkeypatch.setattr(shards.ShardStore, "_publish", publish)
        store.commit(base, store.manifest(base)[:1])  # the other writer
        return publish(self, tmp, final)

    monkeypatch.setattr(shards.ShardStore, "_publish", late)
    with pytest.raises(RuntimeError):
        store.commit(base, [])
    assert store.version() == base + 1 and len(store.manifest()) == 1


LONG = ["x" * 5000, "ab" * 4000 + "!?" * 3000, "ñ" * 4000, "don't<|endoftext|>I'll 12³ ΑΣ", "a\x1cb\x85c\xa0d　e"]


def odd_texts(n: int = 400) -> list[str]:
    """Random texts over letters, signs, blanks and characters that normalise, split or lower in special ways."""
    r = random.Random(7)
    bits = ["a", "B", "the", "'s", "'LL", "'", "!", "?!", "12", "½", "²", "é", "e\u0301", "İ", "ß", "Σ", "ς", "Ⱥ", "\u00a0", "\u2003", "\u0085", "\x1c", "\x00", "\u00ad", "漢字", "ﬁ", "🙂", "<|endoftext|>", "<|", "</w>", "w>", " ", "\n", "\t", "\r\n"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_bpe(spark, docs, empty):
    path = queries.tokenizer_path()
    r = random.Random(2)
    more = [*LONG, "".join(r.choice("theandiox") for _ in range(9000)), *odd_texts()]
    own = docs.union(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(more, 1000)], DOCS)).withColumnRenamed("lang", "ids")
    tok = bpe.Codec(path).tok
    for step in (bpe.STEP, 300):  # short steps: long texts come in pieces
        rows = bpe.encode_decode(own, path, step=step, with_ids=True, with_text=True).collect()
        assert len(rows) == own.count()
        for x in rows:
            ids = tok.encode(x.row.text or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            assert (x.n_tokens, x.ids, x.decoded) == (len(ids), ids, text)
            assert x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_forgets_exactly():
    """A table of pre-tokens that overflows at each batch, and a tree for nearly all of them, change nothing."""
    plain, small = bpe.Codec(queries.tokenizer_path()), bpe.Codec(queries.tokenizer_path(), leaf=2, cache=5)
    for k in range(0, 400, 20):
        batch = [t.encode() for t in odd_texts()[k : k + 20]]
        want = [plain.tok.encode(t.decode(), add_special_tokens=False).ids for t in batch]
        for c in (plain, small):
            ends, ids = c.encode(batch)
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


@pytest.mark.parametrize("leaf", [2, 8, 50])
def test_tree_concatenation(leaf):
    c = bpe.Codec(queries.tokenizer_path())
    spec = json.loads(c.tok.to_str())["model"]
    tree = bpe.TreeEncoder(spec, leaf)
    r = random.Random(leaf)
    words_ = ["".join(r.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "theandiong", "!?#*", "aeiou", "</w>") for n in (1, 9, 51, 400, 1500)]
    assert tree.encode(words_) == [[t.id for t in c.tok.model.tokenize(s)] for s in words_]
    assert tree.encode([]) == []


def test_bpe_one_huge_run():
    """A run of 300,000 bytes without a split point: only the tree handles it, in bounded windows."""
    c = bpe.Codec(queries.tokenizer_path())
    r = random.Random(1)
    text = "".join(r.choice("theandiongrs") for _ in range(300_000))
    ends, ids = c.encode([text.encode(), b"x"])
    assert ids[: ends[1]].tolist() == c.tok.encode(text, add_special_tokens=False).ids


def test_whole_text_fallback():
    """A tokenizer whose splits keep blanks is used on whole texts."""
    import public_tokenizers

    c = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not c.by_run
    texts_ = ["Hello  world", "", "x"]
    want = [c.tok.encode(t, add_special_tokens=False).ids for t in texts_]
    ends, ids = c.encode([t.encode() for t in texts_])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
    assert c.spell(ends, ids) == ([" ".join(map(str, w)).encode() for w in want], [c.tok.decode(w, skip_special_tokens=False).encode() for w in want])


def rough_documents() -> list[tuple]:
    """Rows for the pipeline: nulls in every column, empty, wordless and very long texts, ties, repeated rows."""
    t = texts(3, 30)
    long = " ".join(f"long{i % 70_000}" for i in range(90_000))
    rows = [(i, x, "en", "s", None if x is None else len(x)) for i, x in enumerate([*t, long, near_texts()[0], near_texts()[0] + " tail"])]
    return [*rows, rows[0], rows[2], (None, t[1], None, None, None), (None, None, None, None, None), (5, t[7], "pt", None, 3)]


def test_pipeline_on_rough_rows(spark, tmp_path):
    """Every stage on nulls, ties, repeated rows, long texts and empty tables, against brute force."""
    import corpus_pipeline as cp

    sf, rows = str(tmp_path), rough_documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > words.BLOCK)
    assert long
    spark.createDataFrame([(0, 1, 0), (1, 0, None), (None, 1, 1), (2, None, 1), (0, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    item = next(r[1] for r in rows if r[1] and len(r[1].split()) > 20)
    spark.createDataFrame([(1, item), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stage = {name.split()[0]: f for name, f in cp.STAGES}
    key = lambda rs: sorted(map(str, rs))

    got = stage["quality"](spark, docs, sf).collect()
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    scores = model.score(quality.features(pa.array([r[1] for r in rows])))
    assert key(map(tuple, got)) == key(r for r, s in zip(rows, scores, strict=True) if s >= cp.LEAST_QUALITY)
    assert stage["quality"](spark, docs, sf).columns == list(cp.COLUMNS)

    kept = stage["near-duplicates"](spark, docs, sf).collect()
    numbered = [(n, r) for n, r in enumerate(sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]))]
    group = brute_similar([(n, r[1]) for n, r in numbered])  # every row is a document, id 5 has two texts
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(numbered[n][1][0] for n in set(group.values()))
    assert sum(r.doc_id is None for r in kept) == 2
    texts_of = collections.defaultdict(set)
    for n, r in numbered:
        texts_of[group[n]].add((r[0], r[1]))
    for r in kept:
        assert r.doc_id is None or any((r.doc_id, r.text) in g and r.doc_id == min(d for d, _ in g) for g in texts_of.values())

    cut = {(d, n, g): k for d, n, g, k in brute_kept([(d, x) for d, x, *_ in rows])}
    left = stage["repeated"](spark, docs, sf).collect()
    assert len(left) == len(rows)
    want = []
    for (d, x, lang, source, n), (_, _, gone, k) in zip(sorted(rows, key=lambda r: str((r[0], r[1]))), sorted(((d, x, *next((g, k) for (e, m, g), k in cut.items() if e == d and m == len((x or "").split()))) for d, x, *_ in rows), key=lambda r: str((r[0], r[1]))), strict=True):
        want.append((d, k if gone else x, lang, source, len(k) if gone else n))
    assert key(map(tuple, left)) == key(want)

    clean = stage["benchmark"](spark, docs, sf).collect()
    held = set(decontam.shingles(item))
    assert key(map(tuple, clean)) == key(r for r in rows if len(held & set(decontam.shingles(r[1]))) < 0.8 * len(held))

    tok = bpe.Codec(queries.tokenizer_path()).tok
    coded = stage["tokens"](spark, docs, sf).collect()
    assert key((r.doc_id, r.n_tokens) for r in coded) == key((d, len(tok.encode(x or "", add_special_tokens=False).ids)) for d, x, *_ in rows)

    none = docs.limit(0)
    for name, f in cp.STAGES:
        out = f(spark, none, sf)
        assert out.count() == 0 and (name == "tokens" or out.columns == list(cp.COLUMNS))


def test_pipeline(spark):
    """Each stage's decisions against a brute-force version on its own input."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    scratch, seen = Scratch(spark, "p"), []
    for name, stage in cp.STAGES:
        out = scratch.save(stage(spark, docs, sf))
        seen.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    assert [len(s[2]) for s in seen] == sorted((len(s[2]) for s in seen), reverse=True) and all(s[3] == list(cp.COLUMNS) for s in seen[:-1])
    group = brute_similar([(r.doc_id, r.text) for r in seen[1][1]])
    assert {r.doc_id for r in seen[1][2]} == set(group.values())  # of each group the smallest id, and nothing else
    kept = {d: (n, k) for d, _, n, k in brute_kept([(r.doc_id, r.text) for r in seen[2][1]])}
    old = {r.doc_id: r for r in seen[2][1]}
    for r in seen[2][2]:
        n, k = kept[r.doc_id]
        assert r.text == (k if n else old[r.doc_id].text) and r.n_chars == len(r.text)
    items = [set(decontam.shingles(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen[3][1] if not any(s and len(s & set(decontam.shingles(r.text))) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in seen[3][2]} == clean
    tok = bpe.Codec(queries.tokenizer_path()).tok
    text = {r.doc_id: r.text for r in seen[4][1]}
    assert all(list(r.ids) == tok.encode(text[r.doc_id], add_special_tokens=False).ids for r in seen[4][2])
