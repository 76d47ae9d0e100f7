"""Prompts as expressions over a text column; the wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import truncate_marked

JSON_FORM = '{"entities": [{"type": "TYPE", "value": "exact text", "confidence": 0.95}]}'
NONE_FOUND = "No related clause"
#: Batches of types that a document can be asked about.
MOST_BATCHES = 1000
VARIATIONS = ("Read the contract from start to end and list every match.", "Go through the types one by one and search the contract for each.", "First mark candidate passages, then keep those that fit a type exactly.")


def _join(*parts) -> Column:
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _types(types: list[str], about: dict[str, str] | None = None) -> str:
    return "Types:\n" + "\n".join(f"- {t}: {about[t]}" if about and t in about else f"- {t}" for t in types)


def zero_shot(text: Column, types: list[str], about: dict[str, str] | None = None, most: int | None = None) -> Column:
    """Over the whole text unless ``most`` is given."""
    return _join("Extract the entities of these types. Copy the text as it stands.", _types(types, about), f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def few_shot(text: Column, types: list[str], examples: list[tuple[str, str]], n: int = 3, most: int = 100_000) -> Column:
    """With the first ``n`` examples (text, expected JSON)."""
    shown = "\n\n".join(f"Example {i}:\n{t}\n{a}" for i, (t, a) in enumerate(examples[:n], 1))
    return _join("Extract the entities of these types, as in the examples.", _types(types), shown, f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def chain_of_thought(text: Column, types: list[str], most: int = 100_000) -> Column:
    return _join("Work in steps: name the kind of document, find the passages for each type, copy the text, check it, then answer.", _types(types), f"End with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def variation(text: Column, types: list[str], run: Column, most: int | None = None) -> Column:
    """The prompt of a self-consistency run: one of three wordings by run modulo 3; over the whole text unless ``most`` is given."""
    how = F.element_at(F.array(*[F.lit(v) for v in VARIATIONS]), F.pmod(run, F.lit(3)).cast("int") + 1)
    return _join(how, _types(types), f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def question(text: Column, question: Column) -> Column:
    """One clause: copy the passages that answer the question, separated by |||."""
    return _join(F.concat(F.lit("Contract:\n"), text), F.concat(F.lit("Question: "), question), f'Copy the passages that answer it word for word, separated by "|||". If there is none, answer "{NONE_FOUND}".')


def batch(text: Column, types: Column, most: int = 80_000) -> Column:
    """Several clauses (an array column) at once."""
    return _join(F.concat(F.lit("Contract:\n"), truncate_marked(text, most)), F.concat(F.lit("Clauses:\n"), F.array_join(F.transform(types, lambda t: F.concat(F.lit("- "), t)), "\n")), f'Answer with JSON: clause -> passages separated by "|||", or "{NONE_FOUND}".')


def sections(text: Column, names: tuple[str, ...] = ("socios", "sociedade", "registro"), most: int = 20_000) -> Column:
    """First of two phases: which passages belong to which part."""
    return _join("Name the passages of the document that belong to each part: " + ", ".join(names) + ".", "Answer with JSON: " + '{"sections": {' + ", ".join(f'"{n}": ["..."]' for n in names) + "}}", F.concat(F.lit("Document:\n"), F.substr(text, F.lit(1), F.lit(most))))


def from_section(part: Column, kind: str, types: list[str]) -> Column:
    """Second of two phases: the entities of one part of the document."""
    return _join(f"Extract the entities of these types from a passage of the part {kind}. Copy the text as it stands.", _types(types), f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), part))


def grouped(text: Column, groups: dict[str, list[str]], most: int = 100_000) -> Column:
    """The types under the headings of their groups."""
    listed = "\n\n".join(f"{name}:\n" + "\n".join(f"- {t}" for t in ts) for name, ts in groups.items())
    return _join("Extract the entities of these types, group by group. Copy the text as it stands.", listed, f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def grouped_few_shot(text: Column, groups: dict[str, list[str]], examples: dict[str, tuple[str, str]], most: int = 15_000) -> Column:
    """Groups of types, each with its example (text, expected JSON) if it has one."""
    listed = "\n\n".join(f"{name}:\n" + "\n".join(f"- {t}" for t in ts) + (f"\nExample:\n{examples[name][0]}\n{examples[name][1]}" if name in examples else "") for name, ts in groups.items())
    return _join("Extract the entities of these types, as in the examples of each group.", listed, f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def full_reasoning(text: Column, groups: dict[str, list[str]], most: int = 100_000) -> Column:
    """Steps through every group, then the answer in a schema."""
    steps = "\n".join(f"{i}. Search for {name}: {', '.join(ts)}." for i, (name, ts) in enumerate(groups.items(), 1))
    return _join("Work through the document in these steps and note what you find in each.", steps, f"End with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def compact(text: Column, types: list[str], most: int = 100_000) -> Column:
    """A short form: types on one line."""
    return _join(f"Types: {', '.join(types)}. Answer with JSON: {JSON_FORM}", truncate_marked(text, most))


def core(text: Column, types: list[str], about: dict[str, str], most: int = 100_000) -> Column:
    """Only the types that are described, with what counts and what doesn't."""
    own = [t for t in types if t in about]
    return _join("Extract only these core types; leave out what is mentioned in passing.", _types(own, about), f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), truncate_marked(text, most)))


def validation(text: Column, candidates: Column, most: int | None = None) -> Column:
    """Check candidates (array<struct<type,value>>) against the document, or against its first ``most`` characters."""
    shown = text if most is None else F.substr(text, F.lit(1), F.lit(most))
    listed = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c["type"], F.lit(": "), c["value"])), "\n")
    return _join("Check which candidates the document confirms; correct or leave out the others.", F.concat(F.lit("Candidates:\n"), listed), f"Answer with JSON: {JSON_FORM}", F.concat(F.lit("Document:\n"), shown))


STRATEGIES = {"zero_shot": zero_shot, "few_shot": few_shot, "chain_of_thought": chain_of_thought, "self_consistency": variation, "grouped": grouped, "grouped_few_shot": grouped_few_shot, "full_reasoning": full_reasoning, "compact": compact, "core": core}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown prompt strategy {name}")
    return STRATEGIES[name]


def per_batch(docs: DataFrame, batches: DataFrame) -> DataFrame:
    """A row for each document and batch of types (batch, types), with its prompt; batches are a stated set of ``MOST_BATCHES`` rows at most."""
    rows = batches.select("batch", "types").limit(MOST_BATCHES + 1).collect()
    if len(rows) > MOST_BATCHES:
        raise ValueError(f"over {MOST_BATCHES} batches")
    if not rows:
        return docs.limit(0).select("*", F.lit(0).alias("batch"), F.array().cast("array<string>").alias("types"), F.lit("").alias("prompt"))
    listed = F.array(*[F.struct(F.lit(r[0]).alias("batch"), F.array(*map(F.lit, r[1])).alias("types")) for r in sorted(rows)])
    return docs.select("*", F.explode(listed).alias("_b")).select(*docs.columns, "_b.*").withColumn("prompt", batch(F.col("text"), F.col("types")))
