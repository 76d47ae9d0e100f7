"""The annotated items source: ranges, shapes, filters and bad lines."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspan.sources import annotations, items

COLUMNS = ("doc_id", "type", "value", "start", "end")


def made(n: int = 200) -> list[dict]:
    r = random.Random(2)
    out = []
    for i in range(n):
        text = "".join(r.choice("abc dé\n") for _ in range(r.randrange(60)))
        a = r.randrange(70)
        shape = r.randrange(6)
        item: dict = {"id": f"d{i}", ("text", "context", "content")[i % 3]: text}
        if shape == 0:
            item["label"] = [[a, a + r.randrange(8), "T1"], [str(a), "5", "T2"], ["x", 3, "T3"], [1], []]
        elif shape == 1:
            item["labels"] = [[0, len(text), "T2"]]
        elif shape == 2:
            item["annotations"] = [{"type": "T1", "value": "v", "start": 1, "end": 2}, {"label": "T4", "text": "w"}]
        elif shape == 3:
            item["entities"] = [{"label": "T3", "text": "w", "start": 4, "end": 9}]
        out.append(item)
    return out


def rows(df) -> list:
    return sorted(map(str, df.select(*COLUMNS).collect()))


@pytest.fixture
def folder(tmp_path):
    own = made()
    (tmp_path / "a_train.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in own[:120]) + "\n\n", encoding="utf-8")
    (tmp_path / "b_val.json").write_text("\n  " + json.dumps(own[120:170], ensure_ascii=False), encoding="utf-8")
    (tmp_path / "test.jsonl").write_text("\n".join(json.dumps(x) for x in own[170:]), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" \n")
    (tmp_path / "_SUCCESS").write_text("")
    return tmp_path


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("size", [64 << 20, 700, 37])
def test_like_the_column_reader(spark, folder, size, strict):
    """Every cut into ranges gives each item once, as the JSON reader of Spark and the column functions do."""
    items.register(spark)
    got = spark.read.format("annotated_items").option("range", size).option("strict", strict).load(folder.as_uri())
    want = None
    for name, lines in (("a_train.jsonl", True), ("b_val.json", False), ("test.jsonl", True)):
        df = annotations.read_items(spark, (folder / name).as_uri(), lines, strict=strict).select("doc_id", F.explode("annotations").alias("x")).select("doc_id", "x.*")
        want = df if want is None else want.union(df)
    assert rows(got) == rows(want)
    assert got.where("error is not null").count() == 0
    assert {(r.file.rsplit("/", 1)[1], r.split) for r in got.select("file", "split").distinct().collect()} == {("a_train.jsonl", "train"), ("b_val.json", "validation"), ("test.jsonl", "test")}
    if size == 37:
        assert got.rdd.getNumPartitions() > 100


def test_filters_reach_the_reader(spark, folder, monkeypatch):
    items.register(spark)
    df = spark.read.format("annotated_items").load(folder.as_uri())
    every = df.collect()
    for condition, keep in (
        ("type = 'T1'", lambda r: r.type == "T1"), ("type in ('T2', 'T3')", lambda r: r.type in ("T2", "T3")), ("split = 'test' and type = 'T3'", lambda r: r.split == "test" and r.type == "T3"),
        ("split in ('train', 'test')", lambda r: r.split in ("train", "test")), ("start > 3", lambda r: r.start is not None and r.start > 3), ("type is null", lambda r: r.type is None), ("type = 'none'", lambda r: False),
    ):
        assert sorted(map(str, df.where(condition).collect())) == sorted(str(r) for r in every if keep(r)), condition
    reader = items.ItemReader({"path": folder.as_uri()})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("split",), "test"), In(("type",), ("T1", "T2")), EqualTo(("type",), "T2"), GreaterThan(("start",), 3)]))
    assert left == [GreaterThan(("start",), 3)] and (reader.types, reader.splits) == ({"T2"}, {"test"})
    assert [p.file.rsplit("/", 1)[1] for p in reader.partitions()] == ["test.jsonl"]


def test_bad_lines(spark, tmp_path):
    items.register(spark)
    (tmp_path / "x.jsonl").write_text('{"id": 7, "text": "ab", "label": [[0, 1, "T"]]}\nnot json\n[1, 2]\n{"id": "z", "label": 5}\n{"id": "n", "annotations": [3]}\n')
    (tmp_path / "y.json").write_text('[{"id": "k", "text": "q", "label": [[0, 1, "T"]]}, 4')
    (tmp_path / "z.jsonl").write_bytes(b'\xff\xfe broken\n{"id": "ok", "entities": [{"label": "L", "text": "t"}]}')
    got = spark.read.format("annotated_items").load(tmp_path.as_uri()).collect()
    assert {(r.doc_id, r.value) for r in got if r.error is None} == {("7", "a"), ("ok", "t")}
    bad = [(r.file.rsplit("/", 1)[1], r.line) for r in got if r.error]
    assert sorted(bad) == [("x.jsonl", 48), ("x.jsonl", 57), ("x.jsonl", 64), ("x.jsonl", 88), ("y.json", 0), ("z.jsonl", 0)]
    assert spark.read.format("annotated_items").load(tmp_path.as_uri()).where("error is not null").count() == 6


def test_no_files(spark, tmp_path):
    items.register(spark)
    (tmp_path / "_SUCCESS").write_text("")
    assert spark.read.format("annotated_items").load(tmp_path.as_uri()).count() == 0
