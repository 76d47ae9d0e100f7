"""Chat formatting from event logs, in DataFrame functions only.

A log holds one row per event: conversation, sequence number, message, kind,
role and text.  Kinds: ``message`` starts a message, ``delta`` appends streamed
text to it, ``edit`` and ``regenerate`` replace what it says (deltas after a
regeneration append to the new text).  Events of one message are folded first
and conversations are put together from finished messages, so a conversation
with very many events is folded by many tasks.

The template writes each turn as ``<s>`` head text ``</s>``, where the head
marks the role.  Control strings inside texts and role names are escaped by a
backslash after their first character, one more than they already have there,
which ``unescape`` takes away again; no other character changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heads of the known roles; other roles are written out in a head of their own.
HEADS = {"user": "[INST] ", "assistant": "[RESP] ", "system": "[SYS] "}
OPEN, CLOSE, ROLE, ROLE_END = "<s>", "</s>", "[ROLE] ", " [/ROLE] "
#: A control string: its first character, backslashes, the rest of it.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?RESP\]|/?SYS\]|/?ROLE\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?RESP\]|/?SYS\]|/?ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): the final messages of an event log (conv_id, seq, message, kind, role, text).

    Ties of seq are broken by kind, role and text; null texts and roles are
    empty; events of a message before its start belong to an empty message
    at their place; several starts of one message are separate messages; a
    null seq comes last; a null conv_id is a conversation like any other.
    """
    e = F.struct(F.col("seq").isNull().alias("n"), "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(e)).alias("e"))
    size = F.size("e")
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.element_at("e", i)["kind"] == "message"))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(size + 1))

    def message(part: Column) -> Column:
        # the last event that says it all anew, then what was streamed after it
        last = F.aggregate(F.sequence(F.lit(1), F.size(part)), F.lit(1), lambda a, i: F.when(F.element_at(part, i)["kind"] != "delta", i).otherwise(a))
        text = F.array_join(F.transform(F.slice(part, last, F.size(part)), lambda x: x["text"]), "")
        return F.struct(part[0]["seq"].alias("seq"), part[0]["role"].alias("role"), text.alias("text"))

    log = log.select("conv_id", "e", starts.alias("starts"), ends.alias("ends"))
    parts = F.transform("starts", lambda s, k: message(F.slice("e", s, F.element_at("ends", k + 1) - s)))
    return log.select("conv_id", F.explode(parts).alias("m")).select("conv_id", "m.*")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation.

    Turns of one seq are ordered by role and text, those without a seq come
    last; repeated rows are turns of their own; a null conv_id is a
    conversation like any other; an empty table gives an empty one; columns
    that aren't named here are left out.  A conversation is one string, so it
    must fit in one.

    ``mask`` lists the stretches that count for the loss, the assistant's
    texts: the turn's number and the code points [start, end) in its part of
    the output, counted from the turn's ``<s>``.
    """
    turn = F.struct(F.col("seq").isNull().alias("n"), "seq", "role", "text")
    talk = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    head = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])

    def headed(t: Column) -> Column:
        return F.concat(F.lit(OPEN), F.coalesce(F.try_element_at(head, t["role"]), F.concat(F.lit(ROLE), escape(t["role"]), F.lit(ROLE_END))))

    made = F.transform("t", lambda t, k: F.struct(k.alias("turn"), (t["role"] == "assistant").alias("loss"), headed(t).alias("head"), escape(t["text"]).alias("body")))
    talk = talk.select("conv_id", made.alias("p"))
    loss = F.transform(F.filter("p", lambda x: x["loss"]), lambda x: F.struct(x["turn"].alias("turn"), F.char_length(x["head"]).alias("start"), (F.char_length(x["head"]) + F.char_length(x["body"])).alias("end")))
    return talk.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"), loss.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss): roles and texts parsed from the output alone, and the texts under the mask, unescaped and in order.

    One row for each row of ``formatted``; other columns are left out.  A
    conversation without an assistant has an empty loss text.
    """
    raw = F.split("formatted", CLOSE)
    pieces = F.slice(raw, 1, F.size(raw) - 1)  # the output ends with the last turn's close
    df = formatted.select("conv_id", "mask", pieces.alias("p"))
    body = lambda p, h: F.substr(p, F.lit(len(OPEN) + len(h) + 1))

    def parsed(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)^<s>\[ROLE\] (.*?) \[/ROLE\] ", 1)
        own = F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.lit(len(OPEN) + len(ROLE) + len(ROLE_END) + 1) + F.char_length(role))).alias("text"))
        for name, h in HEADS.items():
            own = F.when(p.startswith(OPEN + h), F.struct(F.lit(name).alias("role"), unescape(body(p, h)).alias("text"))).otherwise(own)
        return own

    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr(F.element_at("p", m["turn"] + 1), m["start"] + 1, m["end"] - m["start"]))), "")
    return df.select("conv_id", F.transform("p", parsed).alias("turns"), loss.alias("loss"))
