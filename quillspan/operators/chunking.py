"""Chunkers: a document becomes rows (chunk_id, text, start, end).

Chunks at fixed strides are closed expressions.  Where a chunk's start depends
on the chunk before, an Arrow UDF walks one document at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillspan.functions.text import once, sentences, strip
from quillspan.sources.shared import small_batches

CHUNK = "array<struct<text:string,start:int,end:int>>"
# What ends a sentence, tried in order.
ENDS = (". ", ".\n", "? ", "?\n", "! ", "!\n")

# Heading patterns with the kind of section they open, tried in order.
HEADINGS_FULL = [
    (r"^(CLÁUSULA|Cláusula)\s+(\w+)[:\s\-]*(.*?)$", "clause"),
    (r"^(ARTIGO|Artigo)\s+(\d+)[:\s\-]*(.*?)$", "article"),
    (r"^(\d+)\.\s+(.*?)$", "numbered"),
    (r"^([IVXLCDM]+)\s*[.\-]\s*(.*?)$", "roman"),
    (r"^(ARTICLE|Article)\s+(\w+)[:\s\-]*(.*?)$", "article"),
    (r"^(SECTION|Section)\s+(\d+)[:\s\-]*(.*?)$", "section"),
    (r"^(\d+\.\d+)\s+(.*?)$", "subsection"),
    (r"^([A-Z][A-Z\s]{2,}):?\s*$", "header"),
]
HEADINGS_SHORT = [
    (r"^(CLÁUSULA|Cláusula)\s+(\w+)", "clause"),
    (r"^(ARTIGO|Artigo)\s+(\d+)", "article"),
    (r"^(\d+)\.\s+", "numbered"),
    (r"^([IVXLCDM]+)\s*[.\-]", "roman"),
    (r"^(ARTICLE|Article)\s+(\w+)", "article"),
    (r"^(SECTION|Section)\s+(\d+)", "section"),
]
# Where texts are split, from the largest to the smallest.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def explode_chunks(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """Rows (keep..., chunk_id, text, start, end) from an array of chunks."""
    return docs.select(*keep, F.posexplode(chunks).alias("chunk_id", "c")).select(*keep, "chunk_id", "c.*")


def walk_stride(text: str, size: int, overlap: int, most: int | None = None, to_end: bool = False) -> list[tuple[str, int, int]]:
    step, n = size - overlap, len(text)
    stop = n if to_end else max(-(-(n - size) // step) * step, 0) + 1
    return [(text[s : s + size], s, min(s + size, n)) for s in range(0, min(stop, n), step)[:most]]


def stride(text: Column, size: int, overlap: int, most: int | None = None, to_end: bool = False) -> Column:
    """Windows of ``size`` characters; up to the first that reaches the end, or until starts pass it if ``to_end``.

    One walk over a decoded text: cutting by character positions in an
    expression would read a text anew for each window.
    """
    return _walker(lambda t: walk_stride(t, size, overlap, most, to_end))(text)


def word_windows(text: Column, size: int = 512, overlap: int = 128) -> Column:
    """Windows of words joined by blanks, until starts pass the end (the last may repeat a tail)."""

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(F.array_join(F.slice(words, s + 1, size), " ").alias("text"), s.alias("start"), F.least(s + size, n).alias("end")))

    return once(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), of)


def walk_blanks(text: str, size: int, step: int) -> list[tuple[str, int, int]]:
    n, out = len(text), []
    for s in range(0, min(max(-(-(n - size) // step) * step, 0) + 1, n), step):
        end = min(s + size, n)
        gap = text.find(" ", end) if end < n else -1
        stop = n if gap < 0 else gap
        out.append((text[s:stop], s, stop))
    return out


def blank_extended(text: Column, size: int = 2040, step: int = 1428) -> Column:
    """Windows of ``size`` characters that go on to the next blank."""
    return _walker(lambda t: walk_blanks(t, size, step))(text)


def _walker(walk: Callable[[str], list[tuple[str, int, int]]]):
    @F.arrow_udf(CHUNK)
    def run(texts):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"text": t, "start": s, "end": e} for t, s, e in walk(x or "")] for x in texts.to_pylist()], kind)

    return run


def sliding_end(text: str, at: int, n: int, size: int) -> int:
    """Where a window ends that begins at ``at``: after a sentence if one ends beyond its middle; the kinds of ends are tried in order."""
    end = min(at + size, n)
    if end < n:
        for mark in ENDS:
            hit = text.rfind(mark, at, end)
            if hit - at > size * 0.5:
                return hit + len(mark)
    return end


def full_stop_end(text: str, at: int, n: int, size: int) -> int:
    """Likewise: after the window's last full stop if it lies beyond the middle."""
    end = min(at + size, n)
    if end < n and (hit := text.rfind(".", at, end)) - at > size // 2:
        return hit + 1
    return end


def walk_cuts(end_of: Callable[[str, int, int, int], int], text: str, at: int, stop: int, n: int, size: int, overlap: int) -> tuple[list[tuple[int, int]], int]:
    """The windows (start, end) that begin in [at, stop) of a text of ``n`` characters, and where the next one begins."""
    out = []
    while at < stop:
        end = end_of(text, at, n, size)
        out.append((at, end))
        at = n if end >= n else end - overlap
    return out, at


def walk_sliding(text: str, size: int = 512, overlap: int = 128) -> list[tuple[str, int, int]]:
    """Windows that end after a sentence where one ends beyond their middle."""
    cuts, _ = walk_cuts(sliding_end, text, 0, len(text), len(text), size, overlap)
    return [(body, s, e) for s, e in cuts if (body := text[s:e].strip())]


def walk_full_stops(text: str, size: int = 1000, overlap: int = 200) -> list[tuple[str, int, int]]:
    """Windows that end at their last full stop if it lies beyond the middle."""
    cuts, _ = walk_cuts(full_stop_end, text, 0, len(text), len(text), size, overlap)
    return [(text[s:e], s, e) for s, e in cuts]


def walk_recursive(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int, int]]:
    """Pieces of at most ``size``: packed along the largest separator, too long ones along the next; overlap only in forced cuts."""
    out: list[tuple[str, int, int]] = []
    todo = [(0, len(text), 0)]  # stretches of text with the separator to try
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= size:
            if text[lo:hi].strip():
                out.append((text[lo:hi].strip(), lo, hi))
            continue
        if level == len(separators):
            out.append((text[lo : lo + size].strip(), lo, lo + size))
            if text[lo + size - overlap : hi].strip():
                todo.append((lo + size - overlap, hi, level))
            continue
        mark, cuts, at = separators[level], [lo], lo
        while mark and (hit := text.find(mark, at, hi)) >= 0:
            at = hit + len(mark)
            cuts.append(at)
        cuts = list(range(lo, hi + 1)) if not mark else cuts + [hi]
        packs, begin = [], lo
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - begin > size and a > begin:
                packs.append((begin, a))
                begin = a
        packs.append((begin, hi))
        todo += [(a, b, level + 1 if b - a > size else level) for a, b in reversed(packs)]
    return out


def sliding(text: Column, size: int = 512, overlap: int = 128) -> Column:
    return _walker(lambda t: walk_sliding(t, size, overlap))(text)


def full_stops(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    return _walker(lambda t: walk_full_stops(t, size, overlap))(text)


def recursive(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    return _walker(lambda t: walk_recursive(t, size, overlap))(text)


def pack_sentences(text: Column, size: int = 1024) -> Column:
    """Sentences packed in order until the next would pass ``size`` (each counts its length and one)."""
    chunk = CHUNK.removeprefix("array<").removesuffix(">")
    zero = F.struct(F.array().cast(CHUNK).alias("done"), F.lit(None).cast(chunk).alias("now"), F.lit(0).alias("used"))

    def add(state, s):
        # what is done is copied only when a chunk is added to it
        now = state["now"]
        flush = now.isNull() | (state["used"] + F.char_length(s["text"]) > size)
        done = F.when(flush & now.isNotNull(), F.concat(state["done"], F.array(now))).otherwise(state["done"])
        grown = F.struct(F.concat(now["text"], F.lit(" "), s["text"]).alias("text"), now["start"].alias("start"), s["end"].alias("end"))
        return F.struct(done.cast(CHUNK).alias("done"), F.when(flush, s).otherwise(grown).cast(chunk).alias("now"), (F.when(flush, 0).otherwise(state["used"]) + F.char_length(s["text"]) + 1).alias("used"))

    return F.aggregate(sentences(text), zero, add, lambda z: F.when(z["now"].isNull(), z["done"]).otherwise(F.concat(z["done"], F.array(z["now"]))))


def semantic(parts: DataFrame, key: str, most: int = 1024, least: int = 256, similar: float = 0.7) -> DataFrame:
    """Greedy chunks of sentences (key, pos, text, start, end, vector): a new one begins where the size passes ``most``, or where
    neighbours are less alike than ``similar`` and there are ``least`` characters already.  One document is one group."""
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        groups, size, prev = [], 0, None
        for r in rows.itertuples():
            v = np.asarray(r.vector, float)
            # one root of the product: whole-numbered vectors at exactly ``similar`` aren't moved below it
            cos = 1.0 if prev is None else float(v @ prev) / max(float(np.sqrt((v @ v) * (prev @ prev))), 1e-10)
            if not groups or size + len(r.text) > most or (cos < similar and size >= least):
                groups.append([])
                size = 0
            groups[-1].append(r)
            size += len(r.text) + 1
            prev = v
        return pd.DataFrame([(rows[key].iloc[0], i, " ".join(r.text for r in g), g[0].start, g[-1].end) for i, g in enumerate(groups)], columns=[key, "chunk_id", "text", "start", "end"])

    kind = parts.schema[key].dataType.simpleString()
    return parts.groupBy(key).applyInPandas(fold, f"{key} {kind}, chunk_id int, text string, start int, end int")


def semantic_chunks(docs: DataFrame, key: str, model, text: str = "text", most: int = 1024, least: int = 256, similar: float = 0.7) -> DataFrame:
    """Rows (key, chunk_id, text, start, end): each text's sentences, embedded by ``model`` and chunked as by ``semantic``.

    A row is a document of its own.  Its sentences and vectors stay in one
    Arrow pass, so neither moves between tasks; texts do once, by ``key``.
    """
    import numpy as np
    import pyarrow as pa

    from quillspan.operators.providers import embed_texts

    small_batches(docs.sparkSession)

    def fold(size: list[int], unlike: list[bool], first: list[bool]) -> list[int]:
        """Where chunks begin, among the sentences of a batch."""
        begins, used = [], 0
        for i, (n, cut, new) in enumerate(zip(size, unlike, first, strict=True)):
            if new or used + n > most or (cut and used >= least):
                begins.append(i)
                used = 0
            used += n + 1
        return begins

    def of(keys: pa.Array, found: pa.ListArray) -> pa.RecordBatch:
        bounds = np.concatenate(([0], np.cumsum(found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = found.flatten()
        texts = flat.field("text").to_pylist()
        start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        first, cos = np.zeros(len(texts) + 1, bool), np.ones(len(texts))
        first[bounds[:-1]] = True
        if texts:
            v = np.asarray(embed_texts(model, texts), float)
            square = np.einsum("ij,ij->i", v, v)
            # one root of the product, as in ``semantic``
            cos[1:] = np.einsum("ij,ij->i", v[1:], v[:-1]) / np.maximum(np.sqrt(square[1:] * square[:-1]), 1e-10)
        begin = np.array(fold([len(t) for t in texts], (cos < similar).tolist(), first[:-1].tolist()), np.int64)
        stop = np.append(begin[1:], len(texts))[: len(begin)]
        joined = pa.array([" ".join(texts[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.string())
        at = np.searchsorted(begin, bounds)
        owner = np.repeat(np.arange(len(keys)), np.diff(at))
        columns = [keys.take(pa.array(owner)), np.arange(len(begin)) - at[owner], joined, start[begin], end[stop - 1]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    schema = docs.select(key, F.lit(0).alias("chunk_id"), F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")).schema
    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(schema)])
    own = docs.select(key, text).repartition(key).select(key, sentences(F.col(text)).alias("found"))
    return own.mapInArrow(lambda batches: (of(*b.columns) for b in batches), schema)


def heading_kind(line: Column, patterns: list[tuple[str, str]]) -> Column:
    """The kind of section that a line opens: the first pattern that matches it; null if none does."""
    c = strip(line)
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(patterns):
        out = F.when(c.rlike("(?U)" + pattern), kind).otherwise(out)
    return out


def sections(docs: DataFrame, key: str, text: str = "text", patterns: list[tuple[str, str]] = HEADINGS_SHORT, whole: bool = False) -> DataFrame:
    """(key, section_no, kind, title, text, start, end): headings open sections; what precedes the first is dropped.

    Islands of lines between headings, with exact offsets.  ``whole``: a
    document without a heading is one section of kind document.
    """
    from pyspark.sql import Window

    lines = docs.select(key, F.col(text).alias("t")).select(key, F.posexplode(F.split("t", "\n")).alias("no", "line"))
    lines = lines.select("*", heading_kind(F.col("line"), patterns).alias("kind"))
    w, all_ = Window.partitionBy(key).orderBy("no"), Window.partitionBy(key)
    lines = lines.select("*", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(w).alias("section_no"), (F.sum(F.char_length("line") + 1).over(w) - F.char_length("line") - 1).alias("at"), F.max("no").over(all_).alias("last"), F.count("kind").over(all_).alias("headings"))
    got = lines.where((F.col("section_no") > 0) | (F.lit(whole) & (F.col("headings") == 0)))
    got = got.groupBy(key, "section_no").agg(F.sort_array(F.collect_list(F.struct("no", "line", "kind", "at"))).alias("l"), F.max(F.struct("no", F.col("at") + F.char_length("line") + F.when(F.col("no") == F.col("last"), 0).otherwise(1))).alias("z"))
    first = F.col("l")[0]
    title = F.when(first["kind"].isNull(), "Document").otherwise(strip(first["line"]))
    return got.select(key, F.col("section_no").cast("int").alias("section_no"), F.coalesce(first["kind"], F.lit("document")).alias("kind"), title.alias("title"), F.array_join("l.line", "\n").alias("text"), first["at"].cast("int").alias("start"), F.col("z.col2").cast("int").alias("end"))


def detect_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same with all eight heading patterns and the fallback; a section's text begins with its heading without outer blanks, and its end is where that text ends."""
    got = sections(docs, key, text, HEADINGS_FULL, whole=True)
    body = F.when(F.col("kind") == "document", F.col("text")).otherwise(F.concat("title", F.substr("text", F.char_length(F.substring_index("text", "\n", 1)) + 1)))
    got = got.withColumn("text", body)
    return got.withColumn("end", (F.col("start") + F.char_length("text")).cast("int"))


def section_chunks(found: DataFrame, key: str, most: int = 2048, least: int = 128) -> DataFrame:
    """Sections as chunks: large ones cut by sliding windows, small ones merged (blank line between) until ``least``.

    A document's sections are gathered in one row, and documents are folded batch by batch.
    """
    chunk = "array<struct<text:string,start:int,end:int,kind:string>>"

    def fold(rows: list) -> list:
        out, held, size, begin = [], [], 0, 0

        def flush(end):
            if held:
                out.append(("\n\n".join(held), begin, end, "merged"))
                held.clear()

        for r in rows:
            body = r["text"].strip()
            if len(body) < least:
                begin, size = (begin, size + 2 + len(body)) if held else (r["start"], len(body))
                held.append(body)
                if size >= least:
                    flush(r["end"])
                continue
            flush(r["start"])
            out.extend((t, s + r["start"], e + r["start"], r["kind"]) for t, s, e in walk_sliding(body, most, least // 2)) if len(body) > most else out.append((body, r["start"], r["end"], r["kind"]))
        flush(max((r["end"] for r in rows), default=0))
        return [dict(zip(("text", "start", "end", "kind"), x, strict=True)) for x in out]

    @F.arrow_udf(chunk)
    def folded(found):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.array([fold(rows) for rows in found.to_pylist()], kind)

    whole = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section_no", "text", "start", "end", "kind"))).alias("found"))
    return explode_chunks(whole, folded("found"), key)


def token_windows(n_tokens: Column, size: int, step: int, most: int = 50) -> Column:
    """(first, end) token indexes of windows up to the one that reaches the end, ``most`` at most."""
    starts = F.when(n_tokens > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n_tokens - size) / step).cast("int") * step, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(F.slice(starts, 1, most), lambda s: F.struct(s.alias("first"), F.least(s + size, n_tokens).alias("end")))


def in_window(entities: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Entities that lie whole in a window, with offsets counted from its start (both sides: key, start, end)."""
    e, w = entities.alias("e"), windows.select(key, F.col("start").alias("w_start"), F.col("end").alias("w_end"), "chunk_id").alias("w")
    joined = e.join(w, key).where("e.start >= w_start and e.end <= w_end")
    return joined.select(key, "chunk_id", *[F.col(f"e.{c}") for c in entities.columns if c not in (key, "start", "end")], (F.col("e.start") - F.col("w_start")).alias("start"), (F.col("e.end") - F.col("w_start")).alias("end"))


CHUNKERS: dict[str, Callable[..., Column]] = {"sliding_window": sliding, "recursive": recursive, "sentence": pack_sentences, "full_stop": full_stops, "stride": stride, "words": word_windows}


def chunker(name: str) -> Callable[..., Column]:
    """A chunker by name; unknown names raise."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunker {name}; known: {', '.join(sorted(CHUNKERS))}")
    return CHUNKERS[name]


#: Ways to cut that depend on a window's start only: (where it ends, size, overlap, whether outer blanks and empty windows go).
WALKS = {"sliding": (sliding_end, 512, 128, True), "full_stops": (full_stop_end, 1000, 200, False)}


def chunk_in_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", walk: str = "sliding", piece: int = 1 << 20) -> DataFrame:
    """(key, chunk_id, text, start, end) as ``sliding`` or ``full_stops`` cut, a very long text in many tasks.

    A text becomes pieces of ``piece`` characters with one window's context,
    and each piece is walked from its own beginning, as if a window began
    there.  Where the walk before it comes out at another place, the piece is
    walked again from that place, until every piece begins where the one
    before it ended; walks that meet at a cut go on alike, so two rounds are
    enough as a rule, and as many as pieces in the worst case.  Rows that
    repeat a key are cut each by itself; null and empty texts have no chunks.
    """
    from quillspan.sources.shared import fresh_folder, save

    end_of, size, overlap, bare = WALKS[walk]
    spark = docs.sparkSession
    path = fresh_folder(spark, "pieces")
    own = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).where(F.col("_text") != "")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0)
            for i, whole in enumerate(batch.column(1).to_pylist()):
                n = len(whole)
                for k, lo in enumerate(range(0, n, piece)):
                    # a window that begins before the piece's end may end one window behind it
                    rest = [pa.array([v], t) for v, t in ((k, pa.int32()), (lo, pa.int64()), (min(lo + piece, n), pa.int64()), (n, pa.int64()), (whole[lo : lo + piece + size + 2], pa.string()))]
                    yield pa.RecordBatch.from_arrays([keys.slice(i, 1), pa.array([i], pa.int64()), *rest], ["_key", "_i", "k", "lo", "hi", "n", "part"])

    kind = f"_key {own.schema['_key'].dataType.simpleString()}, _i long, k int, lo long, hi long, n long, part string"
    # a number for each row: its first piece's, handed on to the others
    parts = own.mapInArrow(cut, kind).withColumn("_at", F.monotonically_increasing_id()).withColumn("row", F.col("_at") - F.col("k")).drop("_i", "_at")
    parts = save(parts, f"{path}/parts")

    @F.arrow_udf("out long, chunks int")
    def walked(part, lo, hi, n, at):
        import pyarrow as pa

        rows = []
        for t, a, b, m, s in zip(*(c.to_pylist() for c in (part, lo, hi, n, at)), strict=True):
            cuts, out = walk_cuts(end_of, t, s - a, b - a, m - a, size, overlap)
            rows.append({"out": out + a, "chunks": sum(1 for x, y in cuts if not bare or t[x:y].strip())})
        return pa.array(rows, pa.struct([("out", pa.int64()), ("chunks", pa.int32())]))

    def go(pieces: DataFrame) -> DataFrame:
        return pieces.select("row", "k", "at", walked("part", "lo", "hi", "n", "at").alias("w")).select("row", "k", "at", "w.*")

    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state, turn = save(go(parts.withColumn("at", F.col("lo")).repartition(deal, "row", "k")), f"{path}/round-0"), 0
    by_row = Window.partitionBy("row").orderBy("k")
    while True:
        due = state.withColumn("due", F.coalesce(F.lag("out").over(by_row), F.col("at"))).where("due <> at").select("row", "k", F.col("due").alias("at"))
        due = save(due, f"{path}/due-{turn}")
        if due.isEmpty():
            break
        again = go(parts.join(due, ["row", "k"]))
        turn += 1
        state = save(state.join(due.select("row", "k"), ["row", "k"], "left_anti").union(again), f"{path}/round-{turn}")
    first = state.withColumn("first", (F.sum("chunks").over(by_row) - F.col("chunks")).cast("int")).select("row", "k", "at", "first")

    @F.arrow_udf(CHUNK)
    def chunks(part, lo, hi, n, at):
        import pyarrow as pa

        rows = []
        for t, a, b, m, s in zip(*(c.to_pylist() for c in (part, lo, hi, n, at)), strict=True):
            cuts, _ = walk_cuts(end_of, t, s - a, b - a, m - a, size, overlap)
            made = [(t[x:y].strip() if bare else t[x:y], x + a, y + a) for x, y in cuts]
            rows.append([{"text": v, "start": x, "end": y} for v, x, y in made if v or not bare])
        return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    made = parts.join(first, ["row", "k"]).select(F.col("_key").alias(key), "first", F.posexplode(chunks("part", "lo", "hi", "n", "at")).alias("i", "c"))
    return made.select(key, (F.col("first") + F.col("i")).alias("chunk_id"), "c.*")
