"""The call table: one call a prompt, resumed after a killed task, kept by provider."""

from __future__ import annotations

import collections
import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspan.operators import calls, pipelines, prompts, providers
from quillspan.operators.calls import CallTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TYPES = list(providers.RULES)


class Counting:
    """Writes each prompt it is called with to a file, then asks ``inner``."""

    context_window = 1_000_000

    def __init__(self, inner, file: str, fails: bool = False):
        self.own, self.file, self.fails, self.key = inner, file, fails, f"counting {type(inner).__name__}"

    def generate(self, prompt):
        with open(self.file, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if self.fails:
            raise OSError("no answer")
        return self.own.generate(prompt)

    def prompts(self) -> collections.Counter:
        return collections.Counter(map(json.loads, open(self.file))) if os.path.exists(self.file) else collections.Counter()


@pytest.fixture
def docs(spark):
    rows = [(i, f"Mail a{i % 7}@x{i % 5}.org or B{i % 3}@Y.org\nfrom 10.0.0.{i}\nno. {i}") for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1]), (22, "nothing here"), (23, ""), (24, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_one_call_for_each_prompt(spark, docs, tmp_path):
    hedging, parts = Counting(providers.create("hedging"), f"{tmp_path}/h"), Counting(providers.create("parts"), f"{tmp_path}/p")
    ways = {
        "two_phase": lambda t: pipelines.two_phase(docs, parts, TYPES, calls=t),
        "consistent": lambda t: pipelines.consistent(docs, hedging, TYPES, calls=t),
        "hybrid": lambda t: pipelines.hybrid(docs, hedging, TYPES, calls=t),
        "validation": lambda t: pipelines.by_strategy(docs, hedging, TYPES, "validation", t),
        "ensemble": lambda t: pipelines.hybrid(docs, hedging, TYPES, {"ensemble_slm": {"enabled": True, "models": {"a": (hedging, 1.0), "b": (parts, 0.5)}, "method": "vote"}}, calls=t),
    }
    for name, way in ways.items():
        for p in (hedging, parts):
            p.file = f"{tmp_path}/{name}-{p.key}"
        table = CallTable(spark, (tmp_path / name).as_uri())
        got = way(table)
        first = got.collect()
        assert sorted(map(str, got.collect())) == sorted(map(str, first))
        again = sorted(map(str, way(CallTable(spark, table.path)).collect()))  # a second run finds all replies
        assert again == sorted(map(str, first)), name
        seen = hedging.prompts() + parts.prompts()
        assert seen and set(seen.values()) <= ({1} if name != "ensemble" else {1, 2}), name
        assert sum(seen.values()) == table.log().count()
    # what the rules find in plain words: without a table the two steps agree with a direct call
    want = {(r.doc_id, m["type"], m["value"]) for r in docs.collect() for m in json.loads(providers.create("parts").generate("Document:\n" + (r.text or ""))[0])["entities"]}
    got = pipelines.two_phase(docs.where("text is not null"), providers.create("parts"), TYPES)
    assert {(r.doc_id, r.type, r.value) for r in got.collect()} <= want


def test_consistent_by_hand(spark, docs):
    """Votes and confidences of replies that differ by wording."""
    hedging = providers.create("hedging")
    want = {}
    for r in docs.collect():
        runs = []
        for lead in prompts.VARIATIONS:
            reply = json.loads(hedging.generate(f"{lead}\n\nDocument:\n{r.text or ''}")[0])["entities"]
            first = {}
            for e in reply:
                first.setdefault((e["type"], e["value"].lower()), e)
            runs.append(first)
        for k in {k for run in runs for k in run}:
            hits = [run[k] for run in runs if k in run]
            mean = sum(e["confidence"] for e in hits) / len(hits)
            want[r.doc_id, *k] = (len(hits), round(min(mean * len(hits) / 3, 0.99), 6), hits[-1]["value"])
    got = {(r.doc_id, r.type, r.value.lower()): (r.votes, round(r.confidence, 6), r.value) for r in pipelines.consistent(docs, hedging, TYPES).collect()}
    assert got == want and {v[0] for v in got.values()} >= {2, 3}


def test_errors_are_asked_again(spark, docs, tmp_path):
    p = Counting(providers.create("rules"), f"{tmp_path}/c", fails=True)
    table = CallTable(spark, (tmp_path / "t").as_uri(), every=0)
    asked = docs.withColumn("prompt", F.concat(F.lit("Document:\n"), "text"))
    got = table.ask(asked, F.col("prompt"), p).collect()
    assert len(got) == 17 and all(r.g.reply == "" and r.g.error.startswith("OSError") for r in got)
    p.fails = False
    got = {r.doc_id: r.g for r in table.ask(asked, F.col("prompt"), p).collect()}
    assert all(g.error is None and g.reply for g in got.values()) and got[20] == got[3]
    n = len({r.text for r in docs.collect()})
    assert set(p.prompts().values()) == {2} and table.log().count() == len(p.prompts()) == n
    use = table.usage({p.key: (1.0, 2.0)}).first()
    assert (use.calls, use.errors) == (n, 0) and use.cost == (use.input_tokens + 2 * use.output_tokens) / 1000
    assert table.ask(asked.limit(0), F.col("prompt"), p).count() == 0
    table.drop()
    assert table.log().count() == 0


def test_providers_are_kept_apart(spark, docs, tmp_path):
    table = CallTable(spark, (tmp_path / "t").as_uri())
    a = pipelines.basic(docs, providers.create("rules"), TYPES, table).count()
    b = pipelines.basic(docs, providers.create("hedging"), TYPES, table).count()
    assert b < a and table.log().select("provider").distinct().count() == 2
    few = providers.RuleProvider({"EMAIL": providers.RULES["EMAIL"]})
    assert calls.identity(few) != calls.identity(providers.create("rules"))
    assert calls.identity(providers.Retrying(few, sleep=print)) == calls.identity(few)


KILLED = """
    import os, sys
    sys.path.insert(0, {root!r})
    os.environ["PYTHONPATH"] = {root!r}
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    from quillspan.operators.calls import CallTable

    class Dying:
        context_window, key = 10**6, "dying"

        def generate(self, prompt):
            if prompt.endswith("7") and not os.path.exists({at!r} + "/died"):
                open({at!r} + "/died", "w").close()
                os._exit(1)  # the worker is gone, as with a lost executor
            with open({at!r} + "/calls", "a") as f:
                f.write(prompt + "\\n")
            return prompt.upper(), 1, 1

    spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://" + {at!r}).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    table = CallTable(spark, "file://" + {at!r} + "/table", every=0)
    got = table.ask(spark.range(40).withColumn("p", F.concat(F.lit("p"), F.col("id"))), F.col("p"), Dying()).collect()
    assert sorted(r.g.reply for r in got) == sorted(f"P{{i}}" for i in range(40)), got
    os.rename({at!r} + "/calls", {at!r} + "/done")
"""


def test_a_killed_task_repeats_no_call(tmp_path):
    script = tmp_path / "killed.py"
    script.write_text(textwrap.dedent(KILLED).format(root=ROOT, at=str(tmp_path)))
    ran = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert sorted((tmp_path / "done").read_text().split()) == sorted(f"p{i}" for i in range(40))


def test_a_run_that_ended_is_taken_up(spark, tmp_path):
    """What journals of another driver hold isn't asked again."""
    p = Counting(providers.create("rules"), f"{tmp_path}/c")
    path = (tmp_path / "t").as_uri()
    table = CallTable(spark, path, every=0)
    asked = spark.range(6).withColumn("prompt", F.concat(F.lit("Document:\na"), F.col("id"), F.lit("@b.org")))
    rows = asked.select(F.sha2(F.concat(F.lit(p.key + "\x1f"), "prompt"), 256).alias("d"), "prompt").limit(4).collect()
    journal = calls.Journal(f"{path}/journal/old", 3, 0)
    for r in rows:
        journal.add(dict(zip(calls._FIELDS, (r.d, p.key, "from the journal", 1, 1, 0.5, None), strict=True)))
    got = [r.g.reply for r in table.ask(asked, F.col("prompt"), p).collect()]
    assert got.count("from the journal") == 4 and sum(p.prompts().values()) == 2
    assert not table._folders("journal")


def test_calls_are_paced(spark, tmp_path):
    table = CallTable(spark, (tmp_path / "t").as_uri(), parallel=1, per_second=40.0)
    assert table.gap == pytest.approx(4 / 40)  # four tasks of the local session share it
    used = table.ask(spark.range(6).withColumn("p", F.col("id").cast("string")), F.col("p"), providers.create("rules"))
    assert used.count() == 6
