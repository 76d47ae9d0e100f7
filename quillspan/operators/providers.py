"""Model calls as Arrow UDFs: a small protocol, retries, a rule-based provider that needs no model.

``generate`` never fails a job: an error becomes a value of its struct, as an
empty reply that is scored like one.  Model-backed providers implement
``Provider`` and are registered under a name; none ships here.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import fits, truncate
from quillspan.operators.chunking import stride

REPLY = "struct<reply:string,input_tokens:long,output_tokens:long,error:string>"


class Provider(Protocol):
    context_window: int

    def generate(self, prompt: str) -> tuple[str, int, int]:
        """(reply, input tokens, output tokens)"""


# Shapes that the rule-based provider recognises.
RULES = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IPV4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "PHONE": r"\+\d{1,2} \(\d{3}\) \d{3}-\d{4}",
    "CARD": r"\b\d{16}\b",
    "TOKEN": r"\b[0-9a-f]{40}\b",
}


#: What any match of a rule holds, and is looked for faster; only texts with it are searched by the rule.
NEEDS = {RULES["EMAIL"]: "@", RULES["IPV4"]: r"\d\.\d", RULES["CARD"]: r"\d\d{15}", RULES["TOKEN"]: r"[0-9a-f][0-9a-f]{39}"}


def matches(rules: dict[str, str], text: str) -> list[tuple[str, str]]:
    """(type, value) of the rules' matches, each rule's distinct values in the order of the text."""
    return [(t, m) for t, p in rules.items() if p not in NEEDS or re.search(NEEDS[p], text) for m in dict.fromkeys(re.findall(p, text))]


def document_of(prompt: str) -> str:
    """What follows a prompt's first mark of the document, all of it if there is none; a document may hold the mark itself."""
    _, mark, text = prompt.partition("Document:\n")
    return text if mark else prompt


class RuleProvider:
    """Deterministic: finds what ``rules`` match in the document part of a prompt.  It stands in for a model, it isn't one."""

    context_window = 1_000_000

    def __init__(self, rules: dict[str, str] | None = None):
        self.rules = rules or RULES

    def generate(self, prompt: str) -> tuple[str, int, int]:
        import json

        text = document_of(prompt)
        found = [{"type": t, "value": m, "confidence": 0.9} for t, m in matches(self.rules, text)]
        reply = json.dumps({"entities": found}, ensure_ascii=False)
        return reply, len(prompt) // 4, len(reply) // 4


class PartProvider(RuleProvider):
    """As ``RuleProvider``; asked for the parts of a document it sorts its lines: with an @ to the first part, with a digit to the last.

    Without a line of the first kind its reply isn't JSON.
    """

    def generate(self, prompt: str) -> tuple[str, int, int]:
        import json

        if not prompt.startswith("Name the passages"):
            return super().generate(prompt)
        names = re.match(r"[^:]*: ([^\n]*)\.\n", prompt)[1].split(", ")
        parts: dict[str, list[str]] = {n: [] for n in names}
        for line in prompt.partition("Document:\n")[2].split("\n"):
            if "@" in line:
                parts[names[0]].append(line)
            elif re.search("[0-9]", line):
                parts[names[-1]].append(line)
        reply = json.dumps({"sections": parts}, ensure_ascii=False) if parts[names[0]] else "none"
        return reply, len(prompt) // 4, len(reply) // 4


class HedgingProvider(RuleProvider):
    """As ``RuleProvider``, but the prompt's first line decides what it overlooks and how sure it is.

    Of md5(first line | type | value) the first hex digit leaves a value out
    if it is below 4, the second gives the confidence: 0.2 and 0.05 a step.
    """

    def generate(self, prompt: str) -> tuple[str, int, int]:
        import hashlib
        import json

        lead, text = prompt.partition("\n")[0], document_of(prompt)
        found = []
        for t, m in matches(self.rules, text):
            h = hashlib.md5(f"{lead}|{t}|{m}".encode()).hexdigest()
            if h[0] >= "4":
                found.append({"type": t, "value": m, "confidence": round(0.2 + 0.05 * int(h[1], 16), 2)})
        reply = json.dumps({"entities": found}, ensure_ascii=False)
        return reply, len(prompt) // 4, len(reply) // 4


class Retrying:
    """Tries again after 2^n seconds, capped; the last error is raised."""

    def __init__(self, inner: Provider, tries: int = 3, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.tries, self.base, self.most, self.sleep = inner, tries, base, most, sleep
        self.context_window = inner.context_window

    def generate(self, prompt: str) -> tuple[str, int, int]:
        for n in range(self.tries):
            try:
                return self.inner.generate(prompt)
            except Exception:
                if n == self.tries - 1:
                    raise
                self.sleep(min(self.base * 2**n, self.most))
        raise ValueError("tries must be 1 or more")


_PROVIDERS: dict[str, Callable[..., Provider]] = {"rules": RuleProvider, "parts": PartProvider, "hedging": HedgingProvider}


def register(name: str):
    def keep(make: Callable[..., Provider]):
        _PROVIDERS[name] = make
        return make

    return keep


def providers() -> list[str]:
    return sorted(_PROVIDERS)


def create(name: str, **options) -> Provider:
    if name not in _PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(providers())}")
    return _PROVIDERS[name](**options)


def generate(prompt: Column, provider: Provider) -> Column:
    """struct (reply, input_tokens, output_tokens, error) of each prompt."""

    @F.arrow_udf(REPLY)
    def call(prompts):
        import pyarrow as pa

        out = []
        for p in prompts.to_pylist():
            try:
                reply, i, o = provider.generate(p or "")
                out.append({"reply": reply, "input_tokens": i, "output_tokens": o, "error": None})
            except Exception as e:
                out.append({"reply": "", "input_tokens": 0, "output_tokens": 0, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("reply", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("error", pa.string())]))

    return call(prompt)


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic bag-of-words vectors of unit length; prefixes as instruction-tuned models want them."""

    def __init__(self, dimension: int = 64, query_prefix: str = "", passage_prefix: str = ""):
        self.dimension, self.query_prefix, self.passage_prefix = dimension, query_prefix, passage_prefix

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h & 0x80000000 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out


class LetterEmbedder:
    """Deterministic: how often each of the letters a to z occurs, in any case, plus one for the text itself."""

    dimension, query_prefix, passage_prefix = 27, "", ""

    def embed(self, texts: list[str]) -> list[list[float]]:
        low = [(t or "").lower() for t in texts]
        return [[*(float(t.count(chr(c))) for c in range(97, 123)), 1.0] for t in low]


_EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "letters": LetterEmbedder, "hash-e5": lambda **o: HashEmbedder(query_prefix="query: ", passage_prefix="passage: ", **o)}


def embedder(name: str, **options) -> Embedder:
    if name not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {name}")
    return _EMBEDDERS[name](**options)


def embed(text: Column, model: Embedder, query: bool = False, batch: int = 100, tries: int = 3, wait: float = 1.0) -> Column:
    """Vectors in batches, each tried ``tries`` times with doubling pauses; a batch that fails gives zero vectors."""
    prefix = getattr(model, "query_prefix" if query else "passage_prefix", "")

    @F.arrow_udf("array<double>")
    def run(texts):
        import pyarrow as pa

        return pa.array(embed_texts(model, texts.to_pylist(), prefix, batch, tries, wait), pa.list_(pa.float64()))

    return run(text)


def embed_texts(model: Embedder, texts: list[str | None], prefix: str | None = None, batch: int = 100, tries: int = 3, wait: float = 1.0) -> list[list[float]]:
    """What ``embed`` does for a task's texts; the prefix of passages by default."""
    prefix = getattr(model, "passage_prefix", "") if prefix is None else prefix
    out, own = [], [prefix + (t or " ").replace("\n", " ") for t in texts]
    for at in range(0, len(own), batch):
        out += embed_batch(model, own[at : at + batch], tries, wait)
    return out


def embed_batch(model: Embedder, texts: list[str], tries: int = 3, wait: float = 1.0) -> list[list[float]]:
    for n in range(tries):
        try:
            return model.embed(texts)
        except Exception:
            if n < tries - 1:
                time.sleep(wait * 2**n)
    return [[0.0] * model.dimension] * len(texts)


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """One vector from a token model's output (array<array<double>>): the first token's, or the mean of those that ``mask`` marks by 1."""
    if how == "cls":
        return tokens[0]
    if how != "mean":
        raise ValueError(f"pooling: cls or mean, not {how}")
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    marked = F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x * m))
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(marked, zero, lambda a, t: F.zip_with(a, t, lambda x, y: x + y)), lambda x: x / n)


def extract(docs: DataFrame, provider: Provider, prompt: Callable[[Column], Column], parse: Callable[[Column], Column], how: str = "truncate", size: int = 50_000, overlap: int = 1000, calls=None) -> DataFrame:
    """(doc_id, seq, type, value, confidence) by prompting: ``direct``, ``truncate`` where a text doesn't fit, or ``chunk_aggregate``.

    ``calls``: a ``calls.CallTable`` that keeps the replies; without one the
    model is called as often as the plan refers to the result.
    """
    from quillspan.operators.calls import answer

    if how == "chunk_aggregate":
        parts = docs.select("doc_id", F.posexplode(F.when(fits(F.col("text"), provider.context_window), F.array(F.struct(F.col("text"), F.lit(0).alias("start"), F.char_length("text").alias("end")))).otherwise(stride(F.col("text"), size, overlap))).alias("part", "c")).select("doc_id", "part", F.col("c.text").alias("text"))
    elif how in ("direct", "truncate"):
        own = F.col("text") if how == "direct" else F.when(fits(F.col("text"), provider.context_window), F.col("text")).otherwise(truncate(F.col("text"), int(0.8 * provider.context_window * 4), "both"))
        parts = docs.select("doc_id", F.lit(0).alias("part"), own.alias("text"))
    else:
        raise ValueError(f"unknown strategy {how}")
    got = answer(parts, prompt(F.col("text")), provider, calls).select("doc_id", "part", F.posexplode(parse(F.col("g.reply"))).alias("pos", "x"))
    return got.select("doc_id", (F.col("part").cast("long") * 1_000_000 + F.col("pos")).alias("seq"), "x.*")
