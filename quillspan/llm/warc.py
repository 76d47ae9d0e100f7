"""Deterministic sharded WARC writer and its reader.

Records are range-partitioned and sorted by page id; a task writes its range
into files that roll over once their compressed size passes ``roll_bytes``.
Each record is a gzip member of its own; headers, record ids and digests are
generated anew from the row, with one fixed date, so the same rows give the
same bytes.  Files are written under temporary names and renamed when whole;
the manifest, a table that Spark commits last, names the files that count,
with their sizes and digests.  The reader opens only those and checks them.

Payloads of at least ``least_bytes`` bytes that occur before (smallest page
id first) become ``revisit`` records without a payload.  Which ones is found
on digests alone; the payloads are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch

ROLL_BYTES, LEAST_BYTES, DATE = 64 << 20, 100, "2024-01-01T00:00:00Z"
FORMAT = "WARC/1.1"


def open_store(path: str):
    """(file system, path in it) of a URI, for tasks; local paths and file: URIs included."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id, copy: int, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """The bytes of one record; ``first``: the page id that a revisit refers to, None for a response.

    A record is named by its page, its digest and the number of records before
    it that have both, so a response, the first of its payload, is always
    number 0 and a revisit can name it.
    """
    name = "null" if page_id is None else page_id
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or f"urn:page:{name}")
    kind, body = ("response", payload) if first is None else ("revisit", b"")
    head = [FORMAT, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}:{digest}:{copy}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}:{digest}:0>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(folder: str, roll_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        store, base = open_store(folder)
        done, out, state = [], None, {}

        def begin():
            state.update(name=f"part-{part:06d}-{len(done):05d}.warc.gz", size=0, n=0, sha=hashlib.sha256())
            state["tmp"] = f"{base}/_tmp/{state['name']}.{attempt}-{uuid.uuid4().hex}"
            return store.open_output_stream(state["tmp"], compression=None)

        def end():
            out.close()
            store.move(state["tmp"], f"{base}/{state['name']}")
            done.append((state["name"], state["size"], state["n"], state["sha"].hexdigest()))

        refers, last, before, copy = {}, object(), None, 0
        store.create_dir(f"{base}/_tmp", recursive=True)
        for batch in batches:
            for pid, kind, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pid != last:
                    refers, last, before = {}, pid, None
                if kind == 0:  # a note before its page: the copies of this digest refer to ``first``
                    refers[digest] = first
                    continue
                payload, first = payload or b"", refers.get(digest)
                before, copy = digest, copy + 1 if digest == before else 0
                if first is not None and first == pid and digest not in refers.setdefault("own", set()):
                    refers["own"].add(digest)
                    first = None  # the first of several rows with this id and payload
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(pid, copy, url, payload, digest, first)) + packer.flush()
                out = out or begin()
                out.write(data)
                state["sha"].update(data)
                state["size"] += len(data)
                state["n"] += 1
                if state["size"] >= roll_bytes:
                    end()
                    out = None
        if out:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "bytes", "records", "sha256"])

    return run


def write(pages: DataFrame, folder: str, scratch: Scratch, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives below ``folder``; returns the committed manifest (file, bytes, records, sha256).

    A null payload is empty, a null url is replaced by the page's name, null
    page ids come first and never are what a revisit refers to (payloads under
    null ids only are all response); of rows with one page id and payload the
    first by url is the response.  A payload of any length is one record, held
    whole by the task that writes it.  An empty table gives no file and an
    empty manifest; only the named columns are read.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    keys = own.where(F.octet_length("payload") >= least_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    notes = keys.join(first, "digest").distinct()
    both = own.select("page_id", F.lit(1).alias("kind"), "url", "payload", "digest", F.lit(None).cast("long").alias("first"))
    both = both.union(notes.select("page_id", F.lit(0), F.lit(None), F.lit(None), "digest", "first"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "kind", "digest", "url")
    return scratch.save(both.mapInArrow(_writer(folder, roll_bytes), "file string, bytes long, records long, sha256 string"))


def _members(stream, chunk: int = 1 << 20):
    """The uncompressed bytes of each gzip member of a stream."""
    rest = b""
    while True:
        rest = rest or stream.read(chunk)
        if not rest:
            return
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("a record is cut off")
            parts.append(d.decompress(rest))
            rest = d.unused_data if d.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != FORMAT:
        raise ValueError(f"not a record: {lines[0][:40]}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = body[: int(fields["Content-Length"])]
    return fields, body


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) from the archives that the manifest names."""

    def run(batches):
        store, base = open_store(folder)
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0

                def out(rows):
                    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        h, body = parse(data)
                        kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload doesn't have its digest")
                        pid = h["WARC-Record-ID"].split(":")[2]
                        ref = h["WARC-Refers-To"].split(":")[2] if kind == "revisit" else None
                        rows.append((None if pid == "null" else int(pid), h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, kind, None if ref is None else int(ref), body if kind == "response" else None))
                        if len(rows) == 256:
                            seen += len(rows)
                            yield out(rows)
                            rows = []
                seen += len(rows)
                yield out(rows)
                if seen != count:
                    raise ValueError(f"{name}: {seen} records, {count} in the manifest")

    n = max(1, min(manifest.count(), 4096))
    return manifest.select("file", "records").repartition(n).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` to a fresh folder in the shared one and read the archives back."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.path}/archive"
    return read(write(pages, folder, scratch, roll_bytes), folder)
