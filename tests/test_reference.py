"""Operators on small hand-made rows, against plain Python where they fold."""

from __future__ import annotations

import json
import math
import os
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.functions import similarity as S
from quillspan.functions import text as T
from quillspan.functions import validate as V
from quillspan.operators import bio, chunking, entities, evaluate, parse, pipelines, providers, retrieval
from quillspan.sources import annotations, config, sinks


def one(spark, col, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(col(*[F.col(n) for n in names])).first()[0]


def test_registry_is_whole():
    known, sql = entry.queries(), entry.oracle_sql()
    assert len(known) > 80 and set(sql) <= set(known)


def test_text(spark):
    assert one(spark, T.simple, "  A , b! C ") == "a  b c"
    assert one(spark, T.digits_or_spaced, " 12.3-4 / 5") == "12345"
    assert one(spark, T.clause_type, "Ip Ownership") == "IP_OWNERSHIP_ASSIGNMENT"
    assert one(spark, T.tokens, "Élève à l'école ok") == ["élève", "école"]
    assert [tuple(s) for s in one(spark, T.sentences, "One. Two? Three")] == [("One.", 0, 5), ("Two?", 5, 10), ("Three", 10, 15)]
    assert one(spark, T.sentences, "") == []
    assert one(spark, T.clean_document, "a–b “c”\n\n\n\nPage 1 of 2\nx") == 'a-b "c"\nx'
    assert one(spark, lambda a: T.advanced(a), "The ﬁrst $1,000.50 payment of 5%") == "first $1,000.50 payment 5%"
    assert one(spark, lambda a: T.truncate(a, 4, "both", "|"), "abcdefgh") == "ab|gh"
    assert one(spark, lambda a, b: T.context(a, b, 2), "X", "aaxbbb") == "aaxbb..."


def test_validators(spark):
    ok = lambda f, v: one(spark, f, v)
    assert not ok(V.cpf, "111.111.111-11") and ok(V.cpf, "123.456.789-01") and not ok(V.cep, "00999-999") and ok(V.cep, "01000-000")
    assert ok(V.date_pt, "em 15 de março de 2020") and not ok(V.date_pt, "2020")
    assert ok(V.party, "Licensor")[0] and not ok(V.party, "the parties")[0] and ok(V.doc_name, "ABC X")[0] and ok(V.agreement_date, "maybe")[0]
    assert not one(spark, V.registry_entity, "orgao_rg->x", "SSP")[0]


def test_chunkers(spark):
    r = random.Random(5)
    for _ in range(30):
        text = "".join(r.choice("ab. \n?!") for _ in range(r.randrange(0, 400)))
        for walk in (lambda t: chunking.walk_sliding(t, 40, 10), lambda t: chunking.walk_full_stops(t, 40, 10), lambda t: chunking.walk_recursive(t, 40, 10)):
            got = walk(text)
            assert all(text[s:e].strip() == c.strip() for c, s, e in got)
            covered = {i for _, s, e in got for i in range(s, e)}
            assert all(i in covered for i, ch in enumerate(text) if ch.strip())
    assert [c["start"] for c in one(spark, lambda a: chunking.stride(a, 4, 2), "abcdefg")] == [0, 2, 4]
    assert one(spark, lambda a: chunking.stride(a, 4, 2), "") == []
    assert [c["text"] for c in one(spark, lambda a: chunking.pack_sentences(a, 12), "One. Two. Three four.")] == ["One. Two.", "Three four."]


def test_sections(spark):
    df = spark.createDataFrame([(1, "before\nARTICLE I Scope\nbody\nSECTION 2\nend"), (2, "none")], "k int, text string")
    got = chunking.sections(df, "k").orderBy("section_no").collect()
    assert [(r["kind"], r["title"], r["start"], r["end"]) for r in got] == [("article", "ARTICLE I Scope", 7, 28), ("section", "SECTION 2", 28, 41)]
    assert chunking.section_chunks(chunking.sections(df, "k"), "k").count() == 1


def test_similarity(spark):
    assert one(spark, S.jaccard, "a b", "B c") == 1 / 3 and one(spark, S.token_recall, "a b", "b, c") == 0.5 and one(spark, S.span_coverage, "x the end y", "The  End") == 1.0
    a, b = "the quick brown fox", "the quack brown ox"
    assert abs(one(spark, S.sequence_ratio, a, b) - SequenceMatcher(None, a, b).ratio()) < 1e-12
    assert S.indel("kitten", "sitting") == 2 * 4 / 13 and S.indel("", "") == 1.0


def test_greedy_matches_a_loop(spark):
    r, words = random.Random(2), ["a b", "a c", "b c", "a b c", "d"]
    pred = [(d, "t", i, r.choice(words)) for d in range(20) for i in range(4)]
    gold = [(d, "t", i, r.choice(words)) for d in range(20) for i in range(3)]
    recall = lambda p, g: len(set(p.split()) & set(g.split())) / len(set(g.split()))
    for best in (False, True):
        tp = 0
        for d in range(20):
            used = set()
            for p in [p for p in pred if p[0] == d]:
                free = [(recall(p[3], g[3]), -g[2]) for g in gold if g[0] == d and g[2] not in used and recall(p[3], g[3]) >= 0.5]
                if free:
                    used.add(-(max(free) if best else max(free, key=lambda x: x[1]))[1])
                    tp += 1
        dfs = [spark.createDataFrame(x, "doc_id long, type string, seq long, value string") for x in (pred, gold)]
        row = evaluate.greedy_protocol(*dfs, by=["type"], best=best).first()
        assert (row.tp, row.fp, row.fn) == (tp, len(pred) - tp, len(gold) - tp)


def test_bio(spark):
    rows = [(1, i, i * 2, i * 2 + 1, x, 0.9 - i / 100) for i, x in enumerate(["I-A", "B-A", "I-A", "I-B", "O", "B-B", "B-B"])]
    df = spark.createDataFrame(rows, "k int, pos int, start int, end int, label string, confidence double")
    spans = lambda how: [(s["type"], s["start"], s["end"]) for s in bio.decode(df, "k", how).first()["spans"]]
    assert spans("start") == [("A", 0, 1), ("A", 2, 5), ("B", 6, 7), ("B", 10, 11), ("B", 12, 13)]
    assert spans("skip") == [("A", 2, 5), ("B", 10, 11), ("B", 12, 13)] == spans("close")
    assert bio.labels(["X", "Y"]) == ["O", "B-X", "I-X", "B-Y", "I-Y"] and bio.labels(["X", "Y"], by_type=False)[2] == "B-Y"


def test_overlaps(spark):
    rows = [(1, 0, "A", "v", 0, 10, 0.5), (1, 1, "A", "w", 5, 12, 0.9), (1, 2, "B", "x", 20, 25, 0.1)]
    df = spark.createDataFrame(rows, "doc_id int, seq long, type string, value string, start int, end int, confidence double")
    for f in (entities.resolve_last, entities.resolve_any):
        assert [r.value for r in f(df, "doc_id").orderBy("seq").collect()] == ["w", "x"]
    assert entities.drop_similar(df, "doc_id").count() == 3


def test_replies(spark):
    got = lambda f, v: [(x["type"], x["value"]) for x in one(spark, f, v)]
    types = ["Party", "Date"]
    assert got(lambda c: parse.retrieval_reply(c, types), '```json\n{"entities":[{"type":"Party","value":"A"}]}\n```') == [("Party", "A")]
    assert got(lambda c: parse.retrieval_reply(c, types), "Party: A Co\nDate = NOT_FOUND") == [("Party", "A Co")]
    assert got(parse.repaired_reply, '{"entities":[{"text":"A","type":"Party"},{"text":"B') == [("Party", "A")]
    assert got(lambda c: parse.spans_reply(c, ["PARTIES"]), '{"Parties":"a ||| b"}') == [("PARTIES", "a"), ("PARTIES", "b")]
    assert got(parse.repaired_reply, "") == []


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.5), (4.0, 5.0), (3.0, 1.0), (6.0, 2.0)], "a double, b double")
    t = evaluate.paired_t(df, "a", "b").first()
    # by hand: differences 1, 1.5, -1, 2, 4; with 4 degrees of freedom the tail has a closed form
    assert abs(t.t - 1.8605) < 1e-3 and abs(t.p - 0.1363) < 1e-3
    assert abs(evaluate.student_tail(2.0, 10) - 0.07339) < 1e-4
    w = evaluate.wilcoxon(df, "a", "b").first()
    assert (w.w_plus, w.w_minus) == (13.5, 1.5)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "test.json").write_text(json.dumps({"data": [{"title": "d", "paragraphs": [{"context": "ACME signs", "qas": [{"question": 'related to "Parties"', "answers": [{"text": "ACME", "answer_start": 0}, {"text": ""}]}]}]}]}))
    a = annotations.answers(annotations.read_qa(spark, annotations.split_path(spark, str(tmp_path), "test"))).collect()
    assert [(r.type, r.value, r.start, r.end) for r in a] == [("Party", "ACME", 0, 4)]
    (tmp_path / "x.jsonl").write_text('{"id": "1", "text": "ACME signs", "label": [[0, 4, "p->q"]]}\n{"id": "2", "text": ""}\n')
    d = annotations.read_items(spark, str(tmp_path / "x.jsonl")).orderBy("doc_id").collect()
    assert d[0].annotations[0].value == "ACME" and d[1].annotations == []
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}} and config.get({"a": {"b": 1}}, "a.b") == 1
    df = spark.createDataFrame([("m", "T", 0.51239, 1)], "model string, type string, f1 double, rank int")
    sinks.write_csv(df, str(tmp_path / "out"), ["model"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().f1 == "0.5124"
    assert "Best: m" in sinks.markdown(df, "R") and "0.5124" in sinks.latex(df) and "<td>m" in sinks.html(df, "R")
    assert sinks.chart_data(df, ("f1",)).count() == 1


def test_provider_errors_become_values(spark):
    class Broken:
        context_window = 100

        def generate(self, prompt):
            raise RuntimeError("down")

    got = one(spark, lambda c: providers.generate(c, Broken()), "p")
    assert got["reply"] == "" and "down" in got["error"]
    waits = []
    try:
        providers.Retrying(Broken(), 3, sleep=waits.append).generate("p")
    except RuntimeError:
        assert waits == [1.0, 2.0]


def test_stream(spark, tmp_path):
    from quillspan.streaming.documents import sentence_stream

    df = spark.createDataFrame([(1, "A b. C d.")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = sentence_stream(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.text for r in spark.table("s").orderBy("pos").collect()] == ["a b.", "c d."]


def test_all_words_of_all_turns(spark, tmp_path):
    """Spans past the twelfth word of a turn, and turns after the first."""
    turns = [" ".join(f"w{t}x{i}" + "y" * (i % 7) for i in range(150)) for t in range(2)]
    spark.createDataFrame([(1, t, "user", x) for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    q = entry.queries()
    got = q["drop_similar"](spark, str(tmp_path)).collect()
    assert sorted(r.value for r in got) == sorted(" ".join(turns).split()) and len({r.seq for r in got}) == 300
    for name in ("resolve_overlaps_last", "resolve_overlaps_any"):
        starts = {r.start for r in q[name](spark, str(tmp_path)).collect()}
        assert max(starts) > 149 * 5 - 20 and len(starts) > 12


def test_documents_are_chunked_and_retrieved(spark, tmp_path):
    """Long documents: the best five of many chunks, against plain Python."""
    r = random.Random(4)
    texts = []
    for d in range(4):
        parts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.randrange(4, 16))) + "." for _ in range(300)]
        for n in range(9):
            parts[r.randrange(300)] = f"Email u{d}n{n}@example.org email."
        texts.append(" ".join(parts))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = entry.queries()
    want, types, model = set(), list(providers.RULES), providers.LetterEmbedder()
    (asked,) = model.embed([" ".join(f"{t}: {t}" for t in types)])
    cos = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    for d, text in enumerate(texts):
        words = text.split()
        parts = [" ".join(words[i : i + 512]) for i in range(0, len(words), 384)]
        assert len(words) >= 1000 and len(parts) > 5
        best = sorted(range(len(parts)), key=lambda i: (-round(cos(model.embed([parts[i]])[0], asked), 9), i))[:5]
        want |= {(d, m) for i in best for m in re.findall(providers.RULES["EMAIL"], parts[i])}
    assert {(x.doc_id, x.value) for x in q["extract_rag"](spark, str(tmp_path)).where("type = 'EMAIL'").collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sentences = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", "s.*")
    got = chunking.semantic(sentences.withColumn("vector", providers.embed(F.col("text"), model)), "doc_id").collect()
    for d, text in enumerate(texts):
        own = sorted((x for x in got if x.doc_id == d), key=lambda x: x.chunk_id)
        assert " ".join(x.text for x in own).split() == text.split() and all(len(x.text) <= 1024 for x in own)


def test_flat_contexts(spark):
    """Short and null texts are their own context; of equal windows the first ones are taken."""

    class Zeros(providers.LetterEmbedder):
        def embed(self, texts):
            return [[0.0] * self.dimension] * len(texts)

    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (2, "a b"), (3, None), (4, "")], "doc_id long, text string")
    make = lambda m: {r[0]: r[1] for r in df.select("doc_id", retrieval.flat_contexts(F.col("text"), m, ["x", "w"], 2, 20, 5, 10)).collect()}
    assert make(providers.LetterEmbedder())[2] == ["a b", "a b"] and make(providers.LetterEmbedder())[3] == ["", ""]
    words = long.split()
    assert make(Zeros())[1] == [" ".join(words[:20]) + " " + " ".join(words[15:35])] * 2


def test_embedding_is_tried_again():
    calls = []

    class Twice(providers.LetterEmbedder):
        def embed(self, texts):
            calls.append(len(texts))
            if len(calls) < 3:
                raise OSError("busy")
            return super().embed(texts)

    assert providers.embed_batch(Twice(), ["ab"], wait=0)[0][:3] == [1.0, 1.0, 0.0] and calls == [1, 1, 1]
    calls.clear()
    assert providers.embed_batch(Twice(), ["ab"], tries=2, wait=0) == [[0.0] * 27]


def test_retrievers(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "delta epsilon"), (1, 2, "alpha alpha zeta"), (2, 0, "alpha")], "k long, chunk_id int, text string")
    asked = spark.createDataFrame([(1, "q", "alpha zeta")], "k long, query_id string, query string")
    for name in retrieval.RETRIEVERS:
        got = retrieval.retriever(name, providers.LetterEmbedder(), 2)(chunks, asked, "k").orderBy("rank").collect()
        assert got and got[0].chunk_id == 2 and len(got) <= 2
    for name, model in (("dense", None), ("hybrid", None), ("nearest", providers.LetterEmbedder())):
        with pytest.raises(ValueError):
            retrieval.retriever(name, model)


def test_strategies(spark):
    df = spark.createDataFrame([(1, "mail a@b.com now\n1.2.3.4 x\nnothing"), (2, "no mail, 1.2.3.4"), (3, None)], "doc_id long, text string")
    types, parts = list(providers.RULES), providers.create("parts")
    want = {(1, "EMAIL", "a@b.com"), (1, "IPV4", "1.2.3.4"), (2, "IPV4", "1.2.3.4")}
    for strategy in ("basic", "validation", "two_phase", "self_consistency"):
        got = pipelines.by_strategy(df, parts, types, strategy).collect()
        assert {(r.doc_id, r.type, r.value) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        pipelines.by_strategy(df, parts, types, "other")
    keys = {"EMAIL": ["@"], "IPV4": ["."]}
    for config in (None, {"pipeline": {"enabled": True, "keywords": keys, "extractor": pipelines.rule_spans(providers.RULES)}}, {"ensemble_slm": {"enabled": True, "models": {"m": (parts, 1.0)}, "method": "union"}}):
        assert {(r.doc_id, r.type, r.value) for r in pipelines.hybrid(df, parts, types, config).collect()} == want


def test_votes_keep_the_most_confident(spark):
    rows = [(1, "m1", 0, "PARTY", "Acme", 0.5), (1, "m2", 1, "PARTY", "ACME ", 0.9), (1, "m1", 2, "PARTY", "acme", 0.9), (1, "m1", 3, "DATE", "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, model string, seq long, type string, value string, confidence double")
    none = spark.createDataFrame([], "model string, weight double")
    for method in ("vote", "weighted_vote", "confidence_max", "union", "unknown"):
        assert {r.value for r in entities.ensemble(df, none, "doc_id", method).where("type = 'PARTY'").collect()} == {"ACME "}


def test_drop_similar_against_a_loop(spark):
    r = random.Random(6)
    words = ["acme", "corp", "inc", "acme", "limited", "of", "north"]
    rows = [(d, i, " ".join(r.choice(words) for _ in range(r.randrange(1, 5)))) for d in range(3) for i in range(40)]
    got = entities.drop_similar(spark.createDataFrame(rows, "doc_id long, seq long, value string"), "doc_id").collect()

    def alike(a, b):
        own, its = set(a.split()), set(b.split())
        return 0.4 * len(own & its) / len(its) + 0.6 * SequenceMatcher(None, a, b).ratio()

    want = []
    for d in range(3):
        kept = []
        for _, i, v in sorted(x for x in rows if x[0] == d):
            if all(alike(v, k) < 0.8 for k in kept):
                kept.append(v)
                want.append((d, i))
    assert sorted((x.doc_id, x.seq) for x in got) == want


def plain_recursive(text, size, overlap, marks):
    """The recursive splitter by string operations, without offsets."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    if not marks:
        head, rest = text[:size].strip(), text[size - overlap :]
        return [head, *(plain_recursive(rest, size, overlap, marks) if rest.strip() else [])]
    parts = re.findall(f"(?s).*?{re.escape(marks[0])}|.+", text) if marks[0] else list(text)
    packs, now = [], ""
    for p in parts:
        if now and len(now) + len(p) > size:
            packs.append(now)
            now = ""
        now += p
    packs.append(now)
    return [c for p in packs for c in plain_recursive(p, size, overlap, marks[1:])]


def test_recursive_chunks_against_strings():
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc", ". ", "\n", "\n\n", " ", "d" * 30]) for _ in range(r.randrange(0, 120)))
        assert [c for c, _, _ in chunking.walk_recursive(text, 40, 10)] == plain_recursive(text, 40, 10, list(chunking.SEPARATORS))


def test_splits_are_exact(spark):
    df = spark.createDataFrame([(i,) for i in range(103)], "doc_id long").repartition(5)
    got = bio.folds(bio.train_validation(df, "doc_id"), "doc_id").collect()
    assert sum(r.split == "validation" for r in got) == int(103 * 0.15)
    assert sorted(Counter(r.fold for r in got).items()) == [(0, 20), (1, 20), (2, 20), (3, 20), (4, 23)]
    assert bio.folds(df.limit(0), "doc_id").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from quillspan.__main__ import main

    main([])
    assert "exact_metrics" in capsys.readouterr().out.split()
    for kind in ("csv", "json", "parquet"):
        main(["exact_metrics", SMALL, "--out", f"{tmp_path}/{kind}", "--format", kind])
        assert getattr(spark.read.option("header", True), kind)(f"{tmp_path}/{kind}").count() == 4
    for wrong in (["nothing", SMALL], ["exact_metrics"]):
        with pytest.raises(SystemExit):
            main(wrong)


SMALL = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in sorted(os.listdir(SMALL))]


def _reference_queries():
    return {n: f for n, f in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}


def test_queries_on_empty_tables(spark, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in _reference_queries().items():
        f(spark, str(tmp_path)).collect()


def test_queries_with_nulls(spark, tmp_path):
    """A row of nulls, an empty text and repeated rows in every table: no query fails."""
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet").limit(30)
        null = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        texts = [F.lit("").alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
        df.union(null).union(df.limit(3)).union(df.limit(1).select(*texts)).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in _reference_queries().items():
        f(spark, str(tmp_path)).collect()


def test_truncated_replies(spark, tmp_path):
    """A reply cut before its last brackets gives no rows to the retrieval parser; the repairing one finds its entities."""
    spark.createDataFrame([(i, f"Word{'abcdef'[i]} rest") for i in range(6)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    q = entry.queries()
    assert sorted({r.item_id for r in q["parse_retrieval"](spark, str(tmp_path)).collect()}) == [0, 1, 2]
    assert sorted((r.type, r.value) for r in q["parse_repaired"](spark, str(tmp_path)).where("item_id = 3").collect()) == [("DATE", "x 3"), ("PARTY", "Wordd")]


def test_every_match_has_its_span(spark):
    """Repeated values, values within longer ones, and characters of two code units."""
    text = "xa@b.com.org a@b.com \U0001f600 1.2.3.4 a@b.com, é 1.2.3.4\n" * 60
    want = {(t, m.group(), m.start(), m.end()) for t, p in providers.RULES.items() for m in re.finditer(p, text)}
    assert len(want) == 300
    df = spark.createDataFrame([(1, text), (2, ""), (3, "none")], "doc_id long, text string")
    got = df.select("doc_id", F.explode(pipelines.rule_spans(providers.RULES)(F.col("text"))).alias("x")).select("doc_id", "x.*").collect()
    assert {(r.type, r.value, r.start, r.end) for r in got} == want and {r.doc_id for r in got} == {1}
    tagged = pipelines.tag_long(df, pipelines.rule_spans(providers.RULES)).collect()
    assert {(r.type, r.value, r.start, r.end) for r in tagged} == want
