"""Vectorised word handling on Arrow text columns.

A batch of texts is cut into blocks of bounded size.  Within a block every
step (word boundaries, word hashes, hashes of word runs) is a handful of numpy
passes over the raw UTF-8 bytes; no Python object is made per word.  A text
longer than a block becomes several pieces, each with the neighbouring words
it needs as context, so memory is bounded by the block and not by the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillspan.llm.xxh64 import windows64, xxh64_runs

#: Bytes of text in a block; a block's arrays of 64-bit numbers take some tens of times as much.
BLOCK = 1 << 18
U64 = np.uint64
#: Odd base of the polynomial hashes of runs of words.
WORD_BASE = 0xD6E8FEB86659FD95
#: Masks that keep the first 0 to 8 bytes of a little-endian 64-bit number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def separators(extra: bytes = b"") -> np.ndarray:
    """A table of 256 flags: ASCII white space and the bytes of ``extra`` separate words."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    t[list(extra)] = True
    return t


SPACE = separators()
#: ASCII white space, controls and punctuation; letters, digits and all non-ASCII bytes make words.
PUNCT = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2^64, ``n`` of each."""
    inverse = U64(pow(base, -1, 1 << 64))
    p, q = np.ones(n, U64), np.ones(n, U64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, base, U64), out=p[1:])
        np.multiply.accumulate(np.full(n - 1, inverse, U64), out=q[1:])
    return p, q


#: The longest tables made for each base of a usual block; those of an outsized one aren't kept.
_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = _kept.get(base, ((), ()))
    if len(p) < n:
        p, q = _powers(base, 1 << max(16, int(n).bit_length()))
        if n <= 2 * BLOCK:
            _kept[base] = p, q
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


class Block:
    """Some texts, or one piece of a long text, as bytes with word boundaries.

    ``rows``: the row of each piece; ``first``: index of each piece's first word
    (one more entry than pieces); ``base``: number of words of the row that lie
    before the piece's first word; ``own``: the piece answers for its words in
    [own[0], own[1]), the others are context.
    """

    def __init__(self, rows: np.ndarray, parts: list[bytes], table: np.ndarray, lower: bool):
        self.rows = np.asarray(rows)
        self.parts = parts
        buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        word = ~table[buf]
        self.buf = LOWER[buf] if lower else buf
        edge = np.empty(len(word) + 1, bool)
        edge[0], edge[-1] = word[0], False
        np.not_equal(word[1:], word[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        self.starts, self.ends = at[0::2], at[1::2]
        self.word = word
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.base = np.zeros(len(parts), np.int64)
        self.own_from, self.own_to = self.first[:-1].copy(), self.first[1:].copy()

    @property
    def n_words(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def piece_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts())

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: of its two halves up to 16 bytes, XXH64 beyond.

        No polynomial over bytes, whose collisions modulo 2^64 are known for
        long strings; distinct words collide by chance only, at 2^-64 a pair.
        """
        size = self.ends - self.starts
        at = windows64(self.buf)
        with np.errstate(over="ignore"):
            low = at[self.starts] & FIRST_BYTES[np.minimum(size, 8)]
            high = at[self.starts + 8] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
            h = mix(mix(low + size.astype(U64) * U64(0xA24BAED4963EE407)) + high * U64(0x9FB21C651E98DF25))
        long = np.flatnonzero(size > 16)
        if len(long):
            h[long] = xxh64_runs(self.buf, self.starts[long], size[long], 0x5EED, at)
        return h


def run_hashes(words: np.ndarray, start: np.ndarray, length, seed: int = 0) -> np.ndarray:
    """Hashes of runs of word hashes: words[start : start + length]."""
    n = len(words)
    p, q = powers(WORD_BASE, n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum((mix(words ^ U64(seed)) if seed else words) * p[:n], out=total[1:])
        h = (total[start + length] - total[start]) * q[start]
        return mix(h + np.asarray(length, np.int64).astype(U64) * U64(0x8CB92BA72F3D8DD7))


def _bytes_of(col) -> tuple[np.ndarray, memoryview]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off and len(col) else np.zeros(1, np.int64)
    return offsets, memoryview(data) if data is not None else memoryview(b"")


def blocks(col, table: np.ndarray = SPACE, lower: bool = False, margin: int = 0, limit: int = BLOCK) -> Iterator[Block]:
    """Cut an Arrow text column into blocks; null texts are empty.

    Every row is in exactly one block, or, if it is longer than ``limit``
    bytes, in several of its own.  ``margin``: words of context that pieces of
    a long row carry on either side.
    """
    off, data = _bytes_of(col)
    n, i = len(off) - 1, 0
    while i < n:
        if off[i + 1] - off[i] > limit:
            yield from _pieces(i, bytes(data[off[i] : off[i + 1]]), table, lower, margin, limit)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Block(np.arange(i, j), [bytes(data[off[k] : off[k + 1]]) for k in range(i, j)], table, lower)
        i = j


def _pieces(row: int, text: bytes, table: np.ndarray, lower: bool, margin: int, limit: int) -> Iterator[Block]:
    """Pieces of one long text, cut between words."""
    raw = np.frombuffer(text, np.uint8)
    cuts, at = [0], 0
    while at < len(text):
        at += limit
        while at < len(text):  # on to the next separator
            gap = np.flatnonzero(table[raw[at : at + limit]])
            if len(gap):
                at += int(gap[0])
                break
            at += limit
        cuts.append(min(at, len(text)))
    done = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, before = _reach(raw, a, -1, margin, table)
        hi, _ = _reach(raw, b, 1, margin, table)
        block = Block(np.array([row]), [text[lo:hi]], table, lower)
        own = int(np.searchsorted(block.starts, b - lo)) - before
        block.base[:] = done - before
        block.own_from[:], block.own_to[:] = before, before + own
        done += own
        yield block


def _reach(raw: np.ndarray, at: int, way: int, words: int, table: np.ndarray) -> tuple[int, int]:
    """The offset ``words`` words before or after ``at``, and how many words there are up to it."""
    span = 64
    while words:
        lo, hi = (max(0, at - span), at) if way < 0 else (at, min(len(raw), at + span))
        word = ~table[raw[lo:hi]]
        if way < 0:
            begins = np.flatnonzero(word & ~np.concatenate(([lo > 0 and not table[raw[lo - 1]]], word[:-1]))) if len(word) else []
            if len(begins) >= words:
                return lo + int(begins[-words]), words
        else:
            begins = np.flatnonzero(word & ~np.concatenate((word[1:], [hi < len(raw) and not table[raw[hi]]]))) if len(word) else []
            if len(begins) >= words:
                return lo + int(begins[words - 1]) + 1, words
        if (lo == 0) if way < 0 else (hi == len(raw)):
            return (lo, len(begins)) if way < 0 else (hi, len(begins))
        span *= 4
    return at, 0


class Texts:
    """Whole texts: one block of several, or all the pieces of a long one.

    ``rows``: the row of each text; ``hashes``: the hashes of all their words
    in order; ``first``: where each text's words begin in them, and the end.
    """

    def __init__(self, parts: list[Block]):
        self.blocks = parts
        self.rows = parts[0].rows
        each = [b.word_hashes() for b in parts]
        self.hashes = np.concatenate(each) if len(each) > 1 else each[0]
        self.first = parts[0].first if len(parts) == 1 else np.array([0, len(self.hashes)])


def whole_texts(col, table: np.ndarray = SPACE) -> Iterator[Texts]:
    """The texts of an Arrow column, each whole; a text's words are held as eight bytes each."""
    held: list[Block] = []
    for b in blocks(col, table):
        if held and (len(b.rows) > 1 or b.rows[0] != held[0].rows[0]):
            yield Texts(held)
            held = []
        held.append(b)
    if held:
        yield Texts(held)
