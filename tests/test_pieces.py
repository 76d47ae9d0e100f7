"""A long text cut in many tasks gives the cuts of one walk."""

from __future__ import annotations

import random

import pytest

from quillspan.operators import chunking

SCHEMA = "doc_id long, text string, start string"


def texts() -> list[str | None]:
    r = random.Random(5)
    prose = "".join(r.choice(["word ", "é", "ab. ", "c?\n", "d! ", "e.\n", " " * 7, "f.", "\n"]) for _ in range(6000))
    return [prose, None, "", " " * 4000, "x" * 9000, "short. text", "a" * 700 + ". " + prose[:3000] + "b" * 5000, "é. " * 2500]


@pytest.mark.parametrize("piece", [1 << 20, 3000, 700])
@pytest.mark.parametrize("walk", sorted(chunking.WALKS))
def test_pieces_against_one_walk(spark, walk, piece):
    own = [(i, t, "s") for i, t in enumerate(texts())] + [(0, texts()[0], "again"), (0, "other. text", "s"), (None, "no key. " * 300, "s")]
    got = sorted(((r.doc_id, r.chunk_id, r.text, r.start, r.end) for r in chunking.chunk_in_pieces(spark.createDataFrame(own, SCHEMA).repartition(3), walk=walk, piece=piece).collect()), key=str)
    one = chunking.walk_sliding if walk == "sliding" else chunking.walk_full_stops
    assert got == sorted(((d, i, *c) for d, t, _ in own for i, c in enumerate(one(t or ""))), key=str)


def test_one_very_long_text(spark):
    """Many pieces of one text, in many tasks; the cuts are those of one walk."""
    r = random.Random(1)
    text = "".join(r.choice(["lorem ", "ipsum. ", "dolor ", "sit? ", "amet\n"]) for _ in range(400_000))
    df = spark.createDataFrame([(1, text, "")], SCHEMA)
    got = [(x.start, x.end) for x in chunking.chunk_in_pieces(df, piece=100_000).orderBy("chunk_id").select("start", "end").collect()]
    assert got == [(s, e) for _, s, e in chunking.walk_sliding(text)]
