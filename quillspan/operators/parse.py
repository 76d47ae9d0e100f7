"""Model replies to entity rows: array<struct<type, value, confidence>>, empty where nothing is found."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import clause_type, strip
from quillspan.functions.validate import is_missing, no_clause

ENTITY = "array<struct<type:string,value:string,confidence:double>>"
_ITEM = "array<struct<type:string,entity_type:string,value:string,text:string,extracted_text:string,confidence:double>>"
_REPLY = f"struct<entities:{_ITEM},extracted_entities:{_ITEM},results:{_ITEM}>"


def unfence(reply: Column) -> Column:
    """What stands in the first fenced block, the whole reply if there is none."""
    block = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(reply.rlike("(?s)```.*```"), block).otherwise(reply)


def _empty() -> Column:
    return F.array().cast(ENTITY)


def _items(reply: Column) -> Column:
    got = F.from_json(reply, _REPLY)
    return F.coalesce(got["entities"], got["extracted_entities"], got["results"], F.from_json(reply, _ITEM))


def _rows(items: Column, missing: str, default: float) -> Column:
    made = F.transform(items, lambda x: F.struct(F.coalesce(x["type"], x["entity_type"]).alias("type"), F.coalesce(x["value"], x["text"], x["extracted_text"]).alias("value"), F.coalesce(x["confidence"], F.lit(default)).alias("confidence")))
    return F.filter(made, lambda x: x["type"].isNotNull() & (x["type"] != "") & x["value"].isNotNull() & (x["value"] != "") & ~is_missing(x["value"], missing))


def by_lines(reply: Column, types: list[str], pattern: str = r"{}[:\s=]+([^\n,]+)", missing: str = "retrieval", confidence: float = 0.7) -> Column:
    """``TYPE: value`` in free text, for each type in order."""

    def of(t: str) -> Column:
        values = F.regexp_extract_all(reply, F.lit("(?i)" + pattern.format(re.escape(t))), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(t).alias("type"), F.regexp_replace(strip(v), "^[\"']+|[\"']+$", "").alias("value"), F.lit(confidence).alias("confidence")))

    found = [of(t) for t in types]
    return F.filter(F.concat(*found), lambda x: (x["value"] != "") & ~is_missing(x["value"], missing)) if found else _empty()


def retrieval_reply(reply: Column, types: list[str]) -> Column:
    """JSON with entities, or lines; default confidence 0.9, 0.7 for lines."""
    return F.coalesce(_rows(_items(unfence(reply)), "retrieval", 0.9), by_lines(reply, types), _empty())


def model_reply(reply: Column, types: list[str]) -> Column:
    """JSON under more names, then three shapes of lines."""
    lines = [by_lines(reply, types, p, "fallback") for p in ("{}[:\\s]+[\"']?([^\"'\\n,]+)[\"']?", r"\*\*{}\*\*[:\s]+([^\n]+)", r"- {}[:\s]+([^\n]+)")]
    return F.coalesce(_rows(_items(unfence(reply)), "model", 0.9), F.array_distinct(F.concat(*lines)), _empty())


def repaired_reply(reply: Column, default: float = 0.85) -> Column:
    """JSON; cut off JSON closed after its last whole object; else the objects one by one."""
    body = unfence(reply)
    closed = F.concat(F.regexp_extract(body, r"(?s)^(.*\})", 1), F.lit("]}"))
    objects = F.regexp_extract_all(body, F.lit(r'(\{\s*"text"\s*:\s*"[^"]*"\s*,\s*"type"\s*:\s*"[^"]*"[^{}]*\})'), F.lit(1))
    single = F.transform(objects, lambda o: F.from_json(o, _ITEM.removeprefix("array<").removesuffix(">")))
    return F.coalesce(_rows(_items(body), "fallback", default), _rows(_items(closed), "fallback", default), _rows(single, "fallback", default), _empty())


def lenient_reply(reply: Column, default: float = 0.85) -> Column:
    """JSON with entities or a list of them, after taking a fence off; else the first of four places in the reply where such JSON stands."""
    bare = F.regexp_replace(strip(F.regexp_replace(strip(reply), "^```(json)?", "")), "```$", "")
    inside = [F.regexp_extract(reply, p, g) for p, g in ((r"```json\s*([\s\S]*?)\s*```", 1), (r"```\s*([\s\S]*?)\s*```", 1), (r'\{[\s\S]*"entities"[\s\S]*\}', 0), (r'\[[\s\S]*\{[\s\S]*"text"[\s\S]*\}[\s\S]*\]', 0))]
    found = [x for part in (strip(bare), *inside) for x in (F.from_json(part, f"struct<entities:{_ITEM}>")["entities"], F.from_json(part, _ITEM))]
    return F.coalesce(_rows(F.coalesce(*found), "fallback", default), _empty())


def typed_reply(reply: Column, types: list[str]) -> Column:
    """(type, value, 1) of the outermost braces in three forms: a list of entities, type -> texts, type -> objects with a text."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    known = F.map_entries(F.from_json(body, "map<string,string>"))
    listed = F.from_json(body, f"struct<entities:{_ITEM}>")["entities"]

    def texts(value: Column) -> Column:
        each = F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), F.when(value.startswith("{"), F.array().cast("array<string>")).otherwise(F.array(value)))
        return F.transform(each, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.text")).otherwise(x))

    pairs = F.flatten(F.transform(known, lambda e: F.transform(texts(e["value"]), lambda v: F.struct(e["key"].alias("type"), v.alias("value")))))
    own = F.transform(listed, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("value")))
    rows = F.transform(F.coalesce(own, pairs), lambda x: F.struct(clause_type(x["type"]).alias("type"), strip(x["value"]).alias("value"), F.lit(1.0).alias("confidence")))
    return F.coalesce(F.filter(rows, lambda x: x["type"].isin(types) & (x["value"] != "")), _empty())


def grouped_reply(reply: Column) -> Column:
    """map<type, array<text>> from the outermost braces: entities grouped by type, or type -> texts."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    lists = F.from_json(body, "map<string,array<string>>")
    rows = F.coalesce(_rows(_items(body), "model", 1.0), _empty())
    grouped = F.map_from_entries(F.transform(F.array_distinct(F.transform(rows, lambda x: x["type"])), lambda t: F.struct(t, F.transform(F.filter(rows, lambda x: x["type"] == t), lambda x: x["value"]))))
    return F.when(F.size(rows) > 0, grouped).otherwise(F.coalesce(lists, F.create_map().cast("map<string,array<string>>")))


def clauses_reply(reply: Column) -> Column:
    """The texts of a ``clauses`` list."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "struct<clauses:array<string>>")["clauses"], F.array().cast("array<string>"))


def spans_reply(reply: Column, types: list[str]) -> Column:
    """``TYPE`` -> texts separated by ``|||``; as JSON or as lines; what says that there is no clause is left out."""
    pairs = F.map_entries(F.from_json(F.regexp_extract(unfence(reply), r"(?s)\{.*\}", 0), "map<string,string>"))
    lines = F.transform(F.filter(F.split(reply, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_extract(x, r"^[^:]*:(.*)$", 1).alias("value")))
    pairs = F.filter(F.coalesce(pairs, lines), lambda p: clause_type(p["key"]).isin(types) & p["value"].isNotNull() & ~no_clause(p["value"]))
    rows = F.flatten(F.transform(pairs, lambda p: F.transform(F.split(p["value"], r"\|\|\|"), lambda v: F.struct(clause_type(p["key"]).alias("type"), strip(v).alias("value"), F.lit(1.0).alias("confidence")))))
    return F.coalesce(F.filter(rows, lambda x: x["value"] != ""), _empty())
