"""End-to-end extraction: retrieval-augmented, segment-wise hybrid, tagging of long documents."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import clean_document
from quillspan.functions.validate import registry_entity, relevant_types
from quillspan.operators import chunking, entities, parse, prompts, providers, retrieval
from quillspan.operators.calls import CallTable
from quillspan.sources.shared import small_batches


def _table(docs: DataFrame, calls: CallTable | None) -> CallTable:
    return calls or CallTable(docs.sparkSession)


def _batches(types: list[str], batch: int) -> list[list[str]]:
    return [types[i : i + batch] for i in range(0, len(types), batch)]


def rag_replies(docs: DataFrame, provider: providers.Provider, types: list[str], model: providers.Embedder | None = None, about: dict[str, str] | None = None, k: int = 5, batch: int = 10, calls: CallTable | None = None, **windows) -> DataFrame:
    """(doc_id, batch, g): the reply to each batch of types, asked with the parts of a document that are most like their descriptions.

    Short documents are asked whole.
    """
    model, groups = model or providers.embedder("hash"), _batches(types, batch)
    queries = [" ".join(f"{t}: {(about or {}).get(t, retrieval.TYPE_QUERIES.get(t, t))}" for t in g) for g in groups]
    own = docs.select("doc_id", clean_document(F.col("text")).alias("text"))
    own = own.select("doc_id", F.posexplode(retrieval.flat_contexts(F.col("text"), model, queries, k, **windows)).alias("batch", "context"))
    prompt = F.element_at(F.array(*[prompts.zero_shot(F.col("context"), g) for g in groups]), F.col("batch") + 1)
    return _table(docs, calls).ask(own, prompt, provider).select("doc_id", "batch", "g")


def rag_entities(replies: DataFrame, types: list[str]) -> DataFrame:
    """(doc_id, seq, type, value, confidence) of the replies; of a document's equal values the first by batch and place stays."""
    rows = replies.select("doc_id", "batch", F.posexplode(parse.retrieval_reply(F.col("g.reply"), types)).alias("pos", "x"))
    return entities.dedup_first(rows.select("doc_id", (F.col("batch").cast("long") * 1_000_000 + F.col("pos")).alias("seq"), "x.*"), "doc_id")


def rag(docs: DataFrame, provider: providers.Provider, types: list[str], *args, **options) -> DataFrame:
    """(doc_id, seq, type, value, confidence) by ``rag_replies`` and ``rag_entities``."""
    return rag_entities(rag_replies(docs, provider, types, *args, **options), types)


def call_statistics(replies: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """Per document of (doc_id, g): calls, failed ones, tokens and what they cost by prices a thousand tokens."""
    got = replies.groupBy("doc_id").agg(F.count("*").alias("calls"), F.count("g.error").alias("errors"), F.sum("g.input_tokens").alias("input_tokens"), F.sum("g.output_tokens").alias("output_tokens"))
    return got.withColumn("cost", (F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1000)


def basic(docs: DataFrame, provider: providers.Provider, types: list[str], calls: CallTable | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, seq, type, value, confidence) by one prompt over the whole text, whether or not it fits the model's window, or over its first ``most`` characters."""
    return providers.extract(docs, provider, lambda t: prompts.zero_shot(t, types, most=most), parse.repaired_reply, "truncate" if most else "direct", calls=_table(docs, calls))


def checked(found: DataFrame) -> DataFrame:
    """Of rows (type, value, ...) those that the registry's rules accept."""
    return found.where(registry_entity(F.col("type"), F.col("value"))["is_valid"])


#: The parts of a document that the two-phase prompt names, and which types each is asked for.
PARTS = {"socios": lambda t: "socio" in t.lower(), "sociedade": lambda t: "->sociedade" in t, "registro": lambda t: "data" in t.lower()}


def two_phase(docs: DataFrame, provider: providers.Provider, types: list[str], most: int = 20_000, calls: CallTable | None = None, whole_most: int | None = 100_000) -> DataFrame:
    """(doc_id, seq, type, value, confidence): first ask which passages belong to which part, then for each passage's entities.

    The first prompt shows ``most`` characters, that for a whole document ``whole_most``.
    Dates of the part ``registro`` aren't checked, the others are.  Where the
    first reply isn't JSON, the document is asked once and checked.  Equal
    rows of a document are one, the first by part and place.  All passages of
    all parts, and the documents asked whole, are one step of the call table.
    """
    calls = _table(docs, calls)
    first = calls.ask(docs.select("doc_id", "text"), prompts.sections(F.col("text"), tuple(PARTS), most), provider)
    first = first.select("doc_id", "text", F.from_json("g.reply", "struct<sections:map<string,array<string>>>")["sections"].alias("s"))
    due = []
    for n, (part, wanted) in enumerate(PARTS.items()):
        own = [t for t in types if wanted(t)]
        due.append(F.transform(F.coalesce(F.try_element_at("s", F.lit(part)), F.array().cast("array<string>")), _passage(n, part, own)))
    whole = F.array(F.struct(F.lit(len(PARTS)).alias("part"), F.lit(0).alias("p"), F.col("text").alias("passage"), prompts.zero_shot(F.col("text"), types, most=whole_most).alias("prompt")))
    asked = first.select("doc_id", F.explode(F.when(F.col("s").isNull(), whole).otherwise(F.filter(F.concat(*due), lambda x: x["passage"] != ""))).alias("q")).select("doc_id", "q.*")
    replies = calls.ask(asked, F.col("prompt"), provider)
    rows = replies.select("doc_id", "part", "p", F.posexplode(parse.repaired_reply(F.col("g.reply"))).alias("pos", "x"))
    rows = rows.select("doc_id", "part", (F.when(F.col("part") < len(PARTS), F.col("part").cast("long") * 10**12 + F.col("p") * 1_000_000).otherwise(F.lit(0)) + F.col("pos")).alias("seq"), "x.*")
    rows = rows.where((F.col("part") == list(PARTS).index("registro")) | registry_entity(F.col("type"), F.col("value"))["is_valid"])
    found = rows.where(F.col("part") < len(PARTS)).drop("part")
    return entities.dedup_first(found, "doc_id", exact=True).unionByName(rows.where(F.col("part") == len(PARTS)).drop("part"))


def _passage(n: int, part: str, types: list[str]):
    """What is asked about a part's passages: (part, place, passage, prompt) of each."""
    return lambda x, i: F.struct(F.lit(n).alias("part"), i.alias("p"), x.alias("passage"), prompts.from_section(x, part, types).alias("prompt"))


def consistent(docs: DataFrame, provider: providers.Provider, types: list[str], runs: int = 3, share: float = 0.5, calls: CallTable | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, type, value, votes, confidence): ``runs`` wordings of the prompt, then self-consistency.

    Whole texts are asked about, or their first ``most`` characters.

    Runs beyond the third repeat a wording, and so a reply: a call table has
    one for each prompt.
    """
    asked = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    got = _table(docs, calls).ask(asked, prompts.variation(F.col("text"), types, F.col("run"), most), provider)
    rows = got.select("doc_id", "run", F.posexplode(parse.repaired_reply(F.col("g.reply"))).alias("pos", "x")).select("doc_id", "run", (F.col("run").cast("long") * 10**12 + F.col("pos")).alias("seq"), "x.*")
    return entities.self_consistency(rows, "doc_id", runs, share)


def by_strategy(docs: DataFrame, provider: providers.Provider, types: list[str], strategy: str = "validation", calls: CallTable | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, type, value, confidence) by ``basic``, ``validation``, ``two_phase`` or ``self_consistency``; others raise.

    ``most``: characters of a text that are asked about, all by default; ``two_phase`` has limits of its own.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; known: {', '.join(STRATEGIES)}")
    limit = {} if strategy == "two_phase" else {"most": most}
    return STRATEGIES[strategy](docs, provider, types, calls=calls, **limit).select("doc_id", "type", "value", "confidence")


STRATEGIES = {"basic": basic, "validation": lambda *a, **b: checked(basic(*a, **b)), "two_phase": two_phase, "self_consistency": consistent}


def run_table(models: list[str], strategies: list[str]) -> list[tuple[str, str]]:
    """Every (model, strategy) of a comparison; unknown strategies raise before anything is called."""
    for name in strategies:
        if name not in STRATEGIES:
            raise ValueError(f"unknown strategy {name}; known: {', '.join(STRATEGIES)}")
    return [(m, s) for m in models for s in strategies]


def run_all(docs: DataFrame, runs: list[tuple[str, str]], models: dict[str, providers.Provider], types: list[str], calls: CallTable | None = None, most: int | None = None) -> DataFrame:
    """(model, strategy, doc_id, type, value, confidence) of every run; runs that ask a model the same share the reply."""
    calls, found = _table(docs, calls), []
    for model, strategy in runs:
        found.append(by_strategy(docs, models[model], types, strategy, calls, most).select(F.lit(model).alias("model"), F.lit(strategy).alias("strategy"), "*"))
    return functools.reduce(DataFrame.unionByName, found)


def hybrid(docs: DataFrame, provider: providers.Provider, types: list[str], config: dict | None = None, model: providers.Embedder | None = None, calls: CallTable | None = None) -> DataFrame:
    """(doc_id, type, value, confidence) by the first of the ways that ``config`` enables, else retrieval with validation.

    ``rag_llm_validation``; ``ensemble_slm``: {"models": {name: (provider, weight)}, "method": ...};
    ``pipeline``: {"keywords": ..., "extractor": ..., "method": ...} as of ``segmented``.
    """
    config, calls = config or {}, _table(docs, calls)
    on = next((n for n in ("rag_llm_validation", "ensemble_slm", "pipeline") if config.get(n, {}).get("enabled")), "rag_llm_validation")
    own = config.get(on, {})
    if on == "ensemble_slm":
        runs = {n: basic(docs, p, types, calls) for n, (p, _) in own["models"].items()}
        weights = docs.sparkSession.createDataFrame([(n, float(w)) for n, (_, w) in own["models"].items()], "model string, weight double")
        found = entities.ensemble(run_models(runs), weights, "doc_id", own.get("method", "weighted_vote"))
    elif on == "pipeline":
        found = segmented(docs, own["keywords"], own["extractor"], method=own.get("method", "section"))
    else:
        found = validated(docs, rag(docs, provider, types, model, calls=calls), provider, types, calls)
    return found.select("doc_id", "type", "value", "confidence")


def validated(docs: DataFrame, found: DataFrame, provider: providers.Provider, types: list[str], calls: CallTable | None = None) -> DataFrame:
    """A second call checks what the first found; ``entities.merge_validation`` joins the two."""
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("c"))
    asked = _table(docs, calls).ask(docs.select("doc_id", "text").join(listed, "doc_id"), prompts.validation(F.col("text"), F.col("c")), provider)
    ok = asked.select("doc_id", F.explode(parse.model_reply(F.col("g.reply"), types)).alias("x")).select("doc_id", "x.*")
    return entities.merge_validation(found, ok, "doc_id")


def segments(docs: DataFrame, method: str = "section", size: int = 2000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_id, text, start, end): the sections of each document, or sliding windows by any other ``method``."""
    if method == "section":
        return chunking.detect_sections(docs, "doc_id").select("doc_id", F.col("section_no").alias("chunk_id"), "text", "start", "end")
    return chunking.explode_chunks(docs, chunking.sliding(F.col("text"), size, overlap), "doc_id")


def segmented(docs: DataFrame, keywords: dict[str, list[str]], extractor, size: int = 2000, overlap: int = 200, method: str = "section") -> DataFrame:
    """Cut, keep segments that mention a type's keyword, extract (a Column function to array<struct<type,value,start,end,confidence>>), shift, drop repeats."""
    small_batches(docs.sparkSession)
    parts = segments(docs, method, size, overlap).withColumnRenamed("start", "at")
    parts = parts.withColumn("relevant", relevant_types(F.col("text"), keywords)).where(F.size("relevant") > 0)
    rows = parts.select("doc_id", "chunk_id", "at", F.posexplode(extractor(F.col("text"))).alias("pos", "x"))
    rows = rows.select("doc_id", (F.col("chunk_id").cast("long") * 1_000_000 + F.col("pos")).alias("seq"), "x.type", "x.value", (F.col("x.start") + F.col("at")).alias("start"), (F.col("x.end") + F.col("at")).alias("end"), "x.confidence")
    return entities.dedup_best(rows, "doc_id")


def tag_long(docs: DataFrame, tagger, max_length: int = 512) -> DataFrame:
    """Tag short documents whole and long ones in windows of 4 max_length characters at half steps, then resolve overlaps."""
    small_batches(docs.sparkSession)
    n = max_length * 4
    text = F.col("text")
    whole = F.array(F.struct(text.alias("text"), F.lit(0).alias("start"), F.char_length(text).alias("end")))
    parts = docs.select("doc_id", F.posexplode(F.when(F.char_length(text) > n, chunking.stride(text, n, n // 2, to_end=True)).otherwise(whole)).alias("w", "c"))
    rows = parts.select("doc_id", "w", F.col("c.start").alias("at"), F.posexplode(tagger(F.col("c.text"))).alias("pos", "x"))
    rows = rows.select("doc_id", (F.col("w").cast("long") * 1_000_000 + F.col("pos")).alias("seq"), "x.type", "x.value", (F.col("x.start") + F.col("at")).alias("start"), (F.col("x.end") + F.col("at")).alias("end"), "x.confidence")
    return entities.resolve_last(rows, "doc_id")


SPANS = "array<struct<type:string,value:string,start:int,end:int,confidence:double>>"


def rule_spans(rules: dict[str, str], confidence: float = 0.9):
    """A tagger of spans by regular expressions, one for each match: text -> array<struct<type,value,start,end,confidence>>.

    All rules go over a text in one Arrow pass that takes the matches' own
    offsets; ``\\d``, ``\\w`` and ``\\b`` are ASCII.  A null text has no spans.
    """
    import re

    compiled = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in rules.items()]

    @F.arrow_udf(SPANS)
    def tag(texts):
        import numpy as np
        import pyarrow as pa

        kinds, values, starts, offsets = [], [], [], [0]
        for text in texts.to_pylist():
            for kind, pattern in compiled:
                for m in pattern.finditer(text or ""):
                    kinds.append(kind)
                    values.append(m.group())
                    starts.append(m.start())
            offsets.append(len(kinds))
        start = np.array(starts, np.int32)
        end = start + np.fromiter(map(len, values), np.int32, len(values))
        spans = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(start), pa.array(end, pa.int32()), pa.array(np.full(len(kinds), confidence))], ["type", "value", "start", "end", "confidence"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)

    return tag


def run_models(results: dict[str, DataFrame]) -> DataFrame:
    """Predictions of several models as one DataFrame with a model column."""
    out = None
    for name, df in results.items():
        df = df.withColumn("model", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
