"""Annotated items as a Spark data source: ``spark.read.format("annotated_items")``.

Rows are annotations (doc_id, type, value, start, end, split, file, line,
error) of files of JSON lines or JSON lists, told apart once a file by their
first character.  JSON lines are read in ranges of bytes, one partition each,
wherever a file is large; a JSON list is one partition.  Conditions on ``type``
and ``split`` are taken over by the reader (with
spark.sql.python.filterPushdown.enabled): files of other splits aren't opened,
annotations of other types aren't made.  A line that is no item gives one row
with ``error`` and nothing else; it never fails a job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quillspan.sources.shared import open_store

SCHEMA = "doc_id string, type string, value string, start int, end int, split string, file string, line long, error string"
_ARROW = pa.schema([("doc_id", pa.string()), ("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("split", pa.string()), ("file", pa.string()), ("line", pa.int64()), ("error", pa.string())])
#: Bytes of a file of JSON lines that one partition reads; rows of a batch.
RANGE, ROWS = 64 << 20, 4096
# Words in a file's name that name its split.
SPLITS = {"train": "train", "validation": "validation", "val": "validation", "test": "test"}


def split_of(name: str) -> str | None:
    """The split that a file's name ends in: train.json, x_val.jsonl, ..."""
    stem = name.rsplit("/", 1)[-1].split(".")[0].lower()
    return SPLITS.get(stem.rsplit("_", 1)[-1])


def _whole(x) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def annotations_of(item: dict, strict: bool) -> Iterator[tuple]:
    """(type, value, start, end) of an item: span triples, else annotations, else entities.

    A triple's value is the text between its ends; ``strict`` keeps triples
    that leave the text, with an empty value, otherwise those that start
    beyond it go.
    """
    text = next((item[k] for k in ("text", "context", "content") if item.get(k) is not None), "")
    spans = next((item[k] for k in ("label", "labels") if item.get(k) is not None), None)
    if spans is not None:
        for s in spans:
            start, end = _whole(s[0] if len(s) > 0 else None), _whole(s[1] if len(s) > 1 else None)
            inside = start is not None and end is not None and start < len(text) and end <= len(text)
            if strict or (start is not None and start < len(text)):
                cut = None if start is None else text[max(start, 0) : max(end or 0, start, 0)]
                yield s[2] if len(s) > 2 else None, ("" if not inside else cut) if strict else cut, start, end
        return
    named = next((item[k] for k in ("annotations", "entities") if item.get(k) is not None), ())
    for a in named:
        yield a.get("type") if a.get("type") is not None else a.get("label"), a.get("value") if a.get("value") is not None else a.get("text"), _whole(a.get("start")), _whole(a.get("end"))


@dataclass
class Piece(InputPartition):
    """The items of a file that begin in [low, high); ``lines``: JSON lines, else a whole JSON list."""

    file: str
    low: int
    high: int
    lines: bool


class ItemReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range = int(options.get("range", RANGE))
        self.strict = str(options.get("strict", "false")).lower() == "true"
        self.types: set[str] | None = None
        self.splits: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and lists for ``type`` and ``split``, whole; all else is left to Spark."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute not in (("type",), ("split",)):
                yield f
            elif f.attribute == ("type",):
                self.types = wanted if self.types is None else self.types & wanted
            else:
                self.splits = wanted if self.splits is None else self.splits & wanted

    def partitions(self) -> Sequence[Piece]:
        from pyarrow import fs

        store, base = open_store(self.path)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type != fs.FileType.File or f.base_name.startswith(("_", ".")) or (self.splits is not None and split_of(f.path) not in self.splits):
                continue
            with store.open_input_stream(f.path) as s:
                first = b""
                while not first.strip() and (block := s.read(1 << 16)):
                    first = block
            if not first.strip():
                continue
            lines = first.lstrip()[:1] != b"["
            step = self.range if lines else f.size
            out += [Piece(f.path, at, min(at + step, f.size), lines) for at in range(0, f.size, step)]
        return out

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        if piece is None:  # no file to read
            return
        store, _ = open_store(self.path)
        split = split_of(piece.file)
        rows: list[dict] = []
        for line, item in _items(store, piece):
            at = {"split": split, "file": piece.file, "line": line}
            try:
                if isinstance(item, bytes):
                    item = json.loads(item)
                if not isinstance(item, dict):
                    raise ValueError("not an object")
                found = [{"doc_id": _text(item.get("id")), "type": t, "value": _text(v), "start": s, "end": e, **at} for t, v, s, e in annotations_of(item, self.strict) if self.types is None or t in self.types]
            except (ValueError, TypeError, AttributeError, KeyError, IndexError) as e:
                # filters on type leave no row without one
                found = [] if self.types is not None else [{**at, "error": f"{type(e).__name__}: {e}"}]
            rows += found
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _items(store, piece: Piece):
    """(byte offset or place, line or item) of what begins in a piece; a line that a piece's end cuts belongs to it whole."""
    if not piece.lines:
        with store.open_input_stream(piece.file) as s:
            try:
                listed = json.loads(s.read())
            except ValueError:
                listed = [None]
        yield from enumerate(listed if isinstance(listed, list) else [None])
        return
    with store.open_input_file(piece.file) as f:
        at = piece.low
        f.seek(max(at - 1, 0))
        buffer = b""
        if at:  # on to the first line that begins here
            while (cut := buffer.find(b"\n")) < 0:
                block = f.read(1 << 16)
                if not block:
                    return
                buffer += block
            at, buffer = at - 1 + cut + 1, buffer[cut + 1 :]
        while at < piece.high:
            if (cut := buffer.find(b"\n")) < 0:
                block = f.read(1 << 20)
                if block:
                    buffer += block
                    continue
                cut = len(buffer)
                if not cut:
                    return
            line, buffer = buffer[:cut], buffer[cut + 1 :]
            if line.strip():
                yield at, line
            at += cut + 1


class AnnotatedItems(DataSource):
    """Options: ``path`` (a file or a folder), ``range`` (bytes of a partition), ``strict``."""

    @classmethod
    def name(cls) -> str:
        return "annotated_items"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ItemReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, filters included."""
    spark.dataSource.register(AnnotatedItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
