"""Text functions: Column in, Column out, all built-in expressions unless said otherwise.

``(?U)`` makes Java's \\w, \\s and \\b follow Unicode.  Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNS = ".,;:!?\"'()[]{}"

# Clause names with a spelling of their own.
CLAUSE_ALIASES = {
    "ROFR/ROFO/ROFN": "ROFR_ROFO_ROFN",
    "IP OWNERSHIP": "IP_OWNERSHIP_ASSIGNMENT",
    "IP_OWNERSHIP": "IP_OWNERSHIP_ASSIGNMENT",
    "AFFILIATE LICENSE-LICENSOR": "AFFILIATE_LICENSE_LICENSOR",
    "AFFILIATE LICENSE-LICENSEE": "AFFILIATE_LICENSE_LICENSEE",
    "UNLIMITED/ALL-YOU-CAN-EAT-LICENSE": "UNLIMITED_ALL_YOU_CAN_EAT_LICENSE",
    "NO SOLICIT OF CUSTOMERS": "NO_SOLICIT_OF_CUSTOMERS",
    "NO SOLICIT OF EMPLOYEES": "NO_SOLICIT_OF_EMPLOYEES",
    "IRREVOCABLE OR PERPETUAL LICENSE": "IRREVOCABLE_OR_PERPETUAL_LICENSE",
}

# Words left out of legal text when comparing.
STOPWORDS = {
    "en": [
        "the", "a", "an", "of", "to", "in", "for", "on", "by", "with", "at", "from", "as", "into", "through", "during", "before", "after", "above",
        "below", "between", "and", "or", "but", "nor", "so", "yet", "such", "any", "all", "each", "every", "other", "shall", "will", "may", "herein",
        "hereof", "hereby", "hereto", "hereunder", "therein", "thereof", "thereby", "thereto", "thereunder", "whereas", "therefore", "provided",
    ],
    "pt": [
        "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "para", "por", "pela",
        "pelo", "pelas", "pelos", "com", "sem", "entre", "sobre", "sob", "ate", "desde", "contra", "perante", "e", "ou", "mas", "porem", "contudo",
        "todavia", "entretanto", "que", "qual", "quais", "este", "esta", "estes", "estas", "esse", "essa", "esses", "essas", "aquele", "aquela",
        "conforme", "mediante", "segundo", "consoante",
    ],
}


def strip(c: Column) -> Column:
    """Without white space at the ends, by Unicode."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_document(c: Column) -> Column:
    """Blanks and blank lines collapsed, curly quotes and dashes straightened, page-number lines dropped."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"(?U)\n\s*\n\s*\n+", "\n\n")
    c = F.translate(c, "“”‘’–—", "\"\"''--")
    c = F.regexp_replace(c, r"(?iU)\n\s*Page\s+\d+\s+of\s+\d+\s*\n", "\n")
    return strip(F.regexp_replace(c, r"(?U)\n\s*-\s*\d+\s*-\s*\n", "\n"))


def simple(c: Column) -> Column:
    """Lower case, white space collapsed, then signs dropped (so " , " leaves two blanks)."""
    return F.translate(collapse(F.lower(c)), SIGNS, "")


def spaced(c: Column) -> Column:
    """Lower case with single blanks."""
    return collapse(F.lower(c))


def digits_or_spaced(c: Column) -> Column:
    """Digits only where the whole value is a number with signs, else ``spaced``."""
    bare = F.regexp_replace(c, r"(?U)\s", "")
    return F.when(bare.rlike(r"(?U)^[\d.\-/]+$"), only_digits(c)).otherwise(spaced(c))


def wordy(c: Column) -> Column:
    """Lower case, single blanks, then everything but word characters and blanks dropped."""
    return F.regexp_replace(collapse(F.lower(c)), r"(?U)[^\w\s]", "")


def only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def clause_type(c: Column) -> Column:
    """Upper case with underscores, after the aliases."""
    alias = F.create_map(*[F.lit(x) for kv in CLAUSE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, F.upper(c)), F.translate(strip(F.upper(c)), " -/", "___"))


def tokens(c: Column, longer_than: int = 2) -> Column:
    """Lower-cased words of more than ``longer_than`` characters, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: F.char_length(w) > longer_than)


def word_set(c: Column) -> Column:
    """Distinct words of a value already normalised."""
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


#: Sentences that one fold adds up; a text's folds are then added up by another.
FOLD = 64


def sentences(c: Column) -> Column:
    """Array of (text, start, end): cut after . ! or ? before white space; text stripped, offsets not.

    Offsets are sums of lengths.  They are added up in blocks of ``FOLD`` and
    over the blocks, so a text of n sentences costs n FOLD + (n / FOLD)^2 steps
    and not n^2.
    """
    kind = "array<struct<text:string,start:int,end:int>>"

    def within(block: Column, base: Column) -> Column:
        def add(state, piece):
            end = state["at"] + F.char_length(piece)
            one = F.struct(strip(piece).alias("text"), state["at"].alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(block, F.struct(base.alias("at"), F.array().cast(kind).alias("out")), add)["out"]

    def of(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.char_length(x)))
        bases = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, bases, within))

    def cut(pieces: Column) -> Column:
        starts = F.when(F.size(pieces) > 0, F.sequence(F.lit(1), F.size(pieces), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(pieces, s, F.lit(FOLD)))

    pieces = F.regexp_extract_all(c, F.lit(r"(?Us).*?[.!?]\s+|.+"), F.lit(0))
    made = once(once(pieces, cut), of)
    return F.when(c.isNotNull(), F.filter(made, lambda s: s["text"] != ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def find(value: Column, text: Column) -> Column:
    """(start, end) of the first occurrence in any case, (-1, -1) if there is none."""
    at = F.instr(F.lower(text), F.lower(value)) - 1
    return F.struct(at.alias("start"), F.when(at < 0, -1).otherwise(at + F.char_length(value)).alias("end"))


def context(value: Column, text: Column, around: int = 100) -> Column:
    """The value's first occurrence with its surroundings, cut ends marked; null if there is none."""
    at = F.instr(F.lower(text), F.lower(value)) - 1
    lo = F.greatest(at - around, F.lit(0))
    hi = F.least(at + F.char_length(value) + around, F.char_length(text))
    part = F.substr(text, lo + 1, hi - lo)
    marked = F.concat(F.when(lo > 0, "...").otherwise(""), part, F.when(hi < F.char_length(text), "...").otherwise(""))
    return F.when(at >= 0, marked)


def truncate(c: Column, n: int, keep: str = "start", marker: str = "\n\n[...]\n\n") -> Column:
    """At most ``n`` characters from the start, the end or both (``marker`` between)."""
    if keep == "start":
        cut = F.substr(c, F.lit(1), F.lit(n))
    elif keep == "end":
        cut = F.right(c, F.lit(n))
    elif keep == "both":
        cut = F.concat(F.substr(c, F.lit(1), F.lit(n // 2)), F.lit(marker), F.right(c, F.lit(n // 2)))
    else:
        raise ValueError(f"keep: start, end or both, not {keep}")
    return F.when(F.char_length(c) > n, cut).otherwise(c)


def truncate_marked(c: Column, n: int | None, marker: str = "\n[... truncated ...]") -> Column:
    """At most ``n`` characters from the start, a cut marked; the whole text if ``n`` is None."""
    if n is None:
        return c
    return F.when(F.char_length(c) > n, F.concat(F.substr(c, F.lit(1), F.lit(n)), F.lit(marker))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4).cast("long")


def fits(c: Column, window: int) -> Column:
    """Does the text fit in nine tenths of a model's context window?"""
    return token_estimate(c) <= 0.9 * window


def demo(c: Column, start: Column, end: Column, text: Column) -> Column:
    """A demonstration: the value cut at 200 characters, with up to 100 characters on either side."""
    return F.struct(F.when(F.char_length(c) > 200, F.concat(F.substr(c, F.lit(1), F.lit(200)), F.lit("..."))).otherwise(c).alias("value"), F.right(F.substr(text, F.greatest(start - 149, F.lit(1)), F.least(start, F.lit(150))), F.lit(100)).alias("before"), F.substr(text, end + 1, F.lit(100)).alias("after"))


def _nfkc(values):
    import unicodedata

    import pyarrow as pa

    return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def advanced(c: Column, language: str = "en", remove_stopwords: bool = True, keep_numbers: bool = True) -> Column:
    """Compatibility form, lower case, words and hyphens only, stopwords out; numbers stay whole.

    A number keeps its decimal point, comma, dollar and percent sign if
    ``keep_numbers``.  Compatibility normalisation is the one step in Python.
    """
    c = F.lower(F.arrow_udf("string")(_nfkc)(c))
    if keep_numbers:
        words = F.regexp_extract_all(c, F.lit(r"(?U)\$?\d[\d,]*\.?\d*%?|[\w\-]+"), F.lit(0))
    else:
        words = F.filter(F.split(F.regexp_replace(c, r"(?U)[^\w\s\-]", " "), r"(?U)\s+"), lambda w: w != "")
    if remove_stopwords:
        words = F.filter(words, lambda w: ~w.isin(STOPWORDS[language]))
    return F.array_join(words, " ")
