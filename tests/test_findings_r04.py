"""The driver's findings of round 4 on small rows that show them."""

from __future__ import annotations

from decimal import Decimal

import duckdb

import __spark_entry__ as entry


def _both(spark, tmp_path, name: str, rows: list, schema: str, table: str = "documents"):
    """Sorted rows of a query over one table: (Spark's, DuckDB's)."""
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = c.execute(f"SELECT {', '.join(f'"{x}"' for x in got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in rows), key=repr)
    return plain(got.collect()), plain(want)


def test_first_chunks_of_empty_and_repeated_documents(spark, tmp_path):
    """No row for a null or empty text, and one for a document that comes twice."""
    rows = [(1, ""), (2, None), (3, " "), (4, "é" * 897), (5, "one " * 500), (5, "one " * 500), (None, "without key")]
    got, want = _both(spark, tmp_path, "first_chunks", rows, "doc_id long, text string")
    assert got == want and {r[0] for r in got} == {3, 4, 5, None}


#: A text of over 100,000 characters with what the rules find at its start, in its middle and at its end; the mark of prompts is in it.
_LONG = "a0@x.org from 10.0.0.1\nDocument:\n" + "word " * 21_000 + " ".join(f"b{i}@y.org 10.0.1.{i}" for i in range(20)) + " word" * 9_000 + " ".join(f" c{i}@z.org 10.0.2.{i}" for i in range(20))
_TEXTS = [(1, _LONG), (2, "d@x.org\nDocument:\n10.0.0.2"), (3, ""), (4, None)]


def test_consistent_extraction_reads_whole_texts(spark, tmp_path):
    got, want = _both(spark, tmp_path, "extract_consistent", _TEXTS, "doc_id long, text string")
    assert got == want and any(r[2].startswith("c") for r in got)


def test_ensemble_extraction_reads_whole_texts(spark, tmp_path):
    got, want = _both(spark, tmp_path, "extract_ensemble", _TEXTS, "doc_id long, text string")
    assert got == want and any(r[2].startswith("c") for r in got)


def test_hybrid_extraction_checks_against_whole_texts(spark, tmp_path):
    """What is found is confirmed from behind the 50,000th character too, and a context of long words is shown whole."""
    rows = [*_TEXTS, (5, "word " * 20_000 + "".join(f" c{i}@z.org 10.0.2.{i}" for i in range(100))), (6, "w" * 120_000 + "".join(f" e{i}@z.org" for i in range(100)))]
    got, want = _both(spark, tmp_path, "extract_hybrid", rows, "doc_id long, text string")
    assert got == want and {r[0] for r in got} == {1, 5, 6}


def test_semantic_chunks_in_one_pass(spark, tmp_path):
    """As the SQL, over null and empty texts too; texts move once between tasks, and their sentences never."""
    words = ["alpha beta gamma.", "zzz yyy xxx!", "Ünter ärger öl?", "one two three four five six seven eight nine ten."]
    rows = [(i, " ".join(words[(i * k + k // 3) % 4] * (1 + k % 3) for k in range(i * 9))) for i in range(12)] + [(20, ""), (21, None), (22, "no end"), (23, "w" * 3000 + ". " + "v. " * 400), (24, "\n \n")]
    got, want = _both(spark, tmp_path, "chunk_semantic", rows, "doc_id long, text string")
    assert got == want and len(got) > 20
    plan = entry.queries()["chunk_semantic"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroupsInPandas" not in plan
