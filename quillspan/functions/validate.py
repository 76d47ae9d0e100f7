"""Validators: Column in, struct (is_valid, note) or boolean out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import only_digits, strip

# Terms and patterns that the rules compare with.
COMPANY_SUFFIXES = ["inc", "inc.", "incorporated", "corp", "corp.", "corporation", "llc", "l.l.c.", "ltd", "ltd.", "limited", "plc", "p.l.c.", "gmbh", "ag", "sa", "s.a.", "nv", "n.v.", "bv", "b.v.", "co", "co.", "company", "lp", "l.p.", "llp", "l.l.p."]
DEFINED_TERMS = ["company", "client", "vendor", "licensor", "licensee", "contractor", "consultant", "provider", "recipient", "seller", "buyer", "lessor", "lessee", "landlord", "tenant", "employer", "employee", "principal", "agent", "customer", "supplier", "distributor", "partner", "member", "shareholder", "investor", "borrower", "lender", "guarantor", "service provider", "parent", "subsidiary", "affiliate", "holder", "owner"]
GENERIC_TERMS = ["party", "parties", "the parties", "each party"]
TITLE_STEMS = ["agreement", "contract", "license", "amendment", "addendum", "memorandum", "letter", "terms"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DATES_PT = [r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{2}\.\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{1,2}\s+de\s+\w+\s+de\s+\d{4}"]
DATES_EN = [
    r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"\b(?:" + "|".join(MONTHS) + r")\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}(?:st|nd|rd|th)?\s+(?:day\s+)?of\s+(?:" + "|".join(MONTHS) + r"),?\s+\d{4}\b",
    r"\b\d{4}[/-]\d{2}[/-]\d{2}\b",
]
NOT_FOUND = {"retrieval": ["NOT_FOUND"], "model": ["NOT_FOUND", "N/A", "NONE", "NULL"], "fallback": ["NOT_FOUND", "N/A", "NONE"]}


def is_missing(value: Column, kind: str = "model") -> Column:
    """Is the value one of the words that say that nothing was found?"""
    return F.upper(value).isin(NOT_FOUND[kind])


def no_clause(value: Column) -> Column:
    return F.lower(value).contains("no related clause")


def cpf(value: Column, strict: bool = True) -> Column:
    """Eleven digits; ``strict``: not all the same."""
    d = only_digits(value)
    ok = F.length(d) == 11
    return ok & ~d.rlike(r"^(\d)\1{10}$") if strict else ok


def cnpj(value: Column) -> Column:
    return F.length(only_digits(value)) == 14


def cep(value: Column, strict: bool = True) -> Column:
    """Eight digits; ``strict``: from 1000000 on."""
    d = only_digits(value)
    ok = F.length(d) == 8
    return ok & (F.coalesce(F.when(ok, d).try_cast("int"), F.lit(0)) >= 1000000) if strict else ok


def rg(value: Column, strict: bool = True) -> Column:
    n = F.length(only_digits(value))
    return n.between(5, 12) if strict else n >= 5


def nire(value: Column) -> Column:
    return F.length(only_digits(value)) >= 8


def date_pt(value: Column) -> Column:
    return value.rlike("(?iU)" + "|".join(DATES_PT))


def n_words(value: Column) -> Column:
    return F.size(F.filter(F.split(value, r"(?U)\s+"), lambda w: w != ""))


def name_pt(value: Column) -> Column:
    return (n_words(value) >= 2) & (F.char_length(value) >= 5)


def _verdict(cases: list[tuple[Column, Column, str]]) -> Column:
    """The first rule whose condition holds gives the verdict; no rule: valid."""
    out = F.struct(F.lit(True).alias("is_valid"), F.lit("").alias("note"))
    for when, ok, note in reversed(cases):
        ok = F.coalesce(ok, F.lit(False))
        out = F.when(when, F.struct(ok.alias("is_valid"), F.when(ok, "OK").otherwise(note).alias("note"))).otherwise(out)
    return out


def registry_entity(kind: Column, value: Column, profile: str = "library") -> Column:
    """Validate by what the type's name contains, in order: ``library``, ``script`` or ``strict_names`` rules."""
    has = lambda s: F.lower(kind).contains(s)
    if profile == "library":
        return _verdict([(has("cpf"), cpf(value), "CPF"), (has("cnpj"), cnpj(value), "CNPJ"), (has("cep"), cep(value), "CEP"), (has("rg"), rg(value), "RG"), (has("data"), date_pt(value), "date"), (has("nome"), name_pt(value), "name")])
    if profile == "script":
        return _verdict([(has("cpf"), cpf(value, False), "CPF"), (has("cnpj"), cnpj(value), "CNPJ"), (has("cep"), cep(value, False), "CEP"), (has("rg"), rg(value, False), "RG"), (has("nire"), nire(value), "NIRE")])
    if profile == "strict_names":
        blank = strip(value) == ""
        return _verdict([(blank, F.lit(False), "blank"), (has("cpf"), cpf(value, False), "CPF"), (has("cnpj"), cnpj(value), "CNPJ"), (has("cep"), cep(value, False), "CEP"), (has("nome") & has("->socio"), n_words(value) >= 2, "name")])
    raise ValueError(f"unknown profile {profile}")


def party(value: Column) -> Column:
    """A defined term or any worded text that isn't generic."""
    low = strip(F.lower(value))
    suffix = F.exists(F.array(*[F.lit(s) for s in COMPANY_SUFFIXES]), lambda s: low.endswith(s) | low.contains(F.concat(F.lit(" "), s)))
    return _verdict([(F.char_length(value) < 2, F.lit(False), "too short"), (low.isin(DEFINED_TERMS), F.lit(True), ""), (low.isin(GENERIC_TERMS), F.lit(False), "generic"), (F.lit(True), suffix | (n_words(value) >= 1), "not a party")])


def doc_name(value: Column) -> Column:
    """Has a word stem of document titles, or is in upper case for the most part."""
    caps = F.char_length(F.regexp_replace(value, r"[^\p{Lu}]", "")) / F.greatest(F.char_length(value), F.lit(1))
    return _verdict([(F.lit(True), F.lower(value).rlike("|".join(TITLE_STEMS)) | (caps > 0.5), "not a document name")])


def agreement_date(value: Column) -> Column:
    """One of four date shapes, or a month's name anywhere."""
    return _verdict([(F.lit(True), F.lower(value).rlike("(?U)" + "|".join(DATES_EN)) | F.lower(value).rlike("|".join(MONTHS)), "not a date")])


def contract_entity(kind: Column, value: Column) -> Column:
    """Dispatch by type; types without a rule are valid."""
    k = F.upper(kind)
    return F.when(k == "PARTY", party(value)).when(k == "DOC_NAME", doc_name(value)).when(k == "AGMT_DATE", agreement_date(value)).otherwise(F.struct(F.lit(True).alias("is_valid"), F.lit("").alias("note")))


def relevant_types(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Types one of whose keywords occurs in the text, in the order declared."""
    low = F.lower(text)
    hits = [F.when(F.coalesce(*[F.when(low.contains(k), True) for k in ks], F.lit(False)), F.lit(t)) for t, ks in keywords.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def all_core(types: Column, core: list[str], most: int = 12) -> Column:
    return (F.size(types) <= most) & F.forall(types, lambda t: t.isin(core))


def narrow(types: Column, frequent: list[str], least: int = 10, first: int = 40) -> Column:
    """The frequent ones of a list of types; if fewer than ``least``, simply its first ``first``."""
    own = F.filter(types, lambda t: t.isin(frequent))
    return F.when(F.size(own) < least, F.slice(types, 1, first)).otherwise(own)


def prioritise(types: Column, priority: list[str], most: int = 10) -> Column:
    """The priority ones first, then the others, cut at ``most``."""
    order = F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(types, p))
    return F.slice(F.concat(order, F.filter(types, lambda t: ~t.isin(priority))), 1, most)
