"""BPE encoding and decoding of whole texts.

White space never lies inside a token of the vocabularies handled here, so a
batch of texts is the sequence of its runs of other bytes.  Runs, and the
pre-tokens that runs split into, are handled as columns: each distinct
pre-token of a batch is encoded once, what it became is kept in a bounded
table, and ids, their decimal forms and the decoded text are put together by
gathering from arrays.

A long pre-token, which nothing splits further, is encoded by tree
concatenation: it is halved down to leaves, all leaves of a batch are encoded
in one parallel call, and neighbours are joined level by level, the joins of a
level in parallel too.  At each join a window of the last tokens on the left
and the first ones on the right is encoded again and grows until its first
token is the left side's and its last token the right side's.  Then every
neighbouring pair of tokens in the result stands in some correct encoding,
which makes the whole the encoding of the whole pre-token.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import bounded_batches
from quillspan.llm.words import SPACE

#: Pre-tokens a worker keeps; characters from which a pre-token is halved; bytes of text handled at a time.
CACHE, LEAF, STEP = 100_000, 16, 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: A run with one of these characters or an added token, or longer than this, is left to the library's own normaliser and splitter.
ODD, PLAIN_MOST = r"[^\x21-\x7e\x{a1}-\x{24f}]", 1 << 16


class TreeEncoder:
    """Encodes long pre-tokens of a BPE model, given as a tokenizers file's ``model``, by tree concatenation."""

    def __init__(self, spec: dict, leaf: int = LEAF, model=None):
        from tokenizers import Tokenizer, models

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        suffix = spec.get("end_of_word_suffix") or ""
        # only the last character of a pre-token carries the word-end suffix
        self.inner = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges))
        self.tail = Tokenizer(model or models.BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=suffix)) if suffix else self.inner
        self.surface = {i: t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t, i in spec["vocab"].items()}
        self.leaf = max(2, leaf)

    def _ids(self, texts: list[str], last: list[bool]) -> list[list[int]]:
        """The ids of stretches; ``last``: whether a stretch ends its pre-token."""
        out: list[list[int]] = [[]] * len(texts)
        for model, kind in ((self.inner, False), (self.tail, True)):
            own = [k for k, x in enumerate(last) if x == kind]
            for k, e in zip(own, model.encode_batch_fast([texts[k] for k in own], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        parts, ends, sizes = [], [], []
        for w in words:
            n = 1
            while len(w) > n * self.leaf:
                n *= 2
            cuts = [k * len(w) // n for k in range(n + 1)]
            parts += [w[a:b] for a, b in itertools.pairwise(cuts)]
            ends += [False] * (n - 1) + [True]
            sizes.append(n)
        level = self._ids(parts, ends)
        while max(sizes, default=1) > 1:
            pairs, last, at = [], [], 0
            for n in sizes:
                if n > 1:
                    pairs += [(level[k], level[k + 1]) for k in range(at, at + n, 2)]
                    last += [False] * (n // 2 - 1) + [True]
                at += n
            joined = iter(self._join(pairs, last))
            above, at = [], 0
            for n in sizes:
                above += [next(joined) for _ in range(n // 2)] if n > 1 else level[at : at + 1]
                at += n
            level, sizes = above, [max(1, n // 2) for n in sizes]
        return level

    def _join(self, pairs: list[tuple], last: list[bool]) -> list[list[int]]:
        out: list = [None] * len(pairs)
        todo, k = list(range(len(pairs))), 2
        while todo:
            spans = [(max(0, len(pairs[i][0]) - k), min(len(pairs[i][1]), k)) for i in todo]
            texts = ["".join(map(self.surface.__getitem__, pairs[i][0][a:] + pairs[i][1][:b])) for i, (a, b) in zip(todo, spans, strict=True)]
            windows = self._ids(texts, [last[i] and b == len(pairs[i][1]) for i, (_, b) in zip(todo, spans, strict=True)])
            rest = []
            for i, (a, b), got in zip(todo, spans, windows, strict=True):
                left, right = pairs[i]
                if (a == 0 or got[0] == left[a]) and (b == len(right) or got[-1] == right[b - 1]):
                    out[i] = left[:a] + got + right[b:]
                else:
                    rest.append(i)
            todo, k = rest, 2 * k
        return out


class _Known:
    """What pre-tokens became: a bounded table of id lists.  On overflow those stay that several batches used."""

    def __init__(self, learn, most: int):
        self.learn, self.most = learn, most
        self.place: dict[str, int] = {}
        self._keep([], pa.array([], pa.list_(pa.int32())))

    def _keep(self, names: list, lists: pa.Array) -> None:
        self.place, self.lists = dict(zip(names, range(len(names)), strict=True)), lists
        self.again = np.zeros(len(names), bool)

    def places(self, names: list[str]) -> np.ndarray:
        """Where in ``lists`` the ids of each name are."""
        new = [w for w in dict.fromkeys(names) if w not in self.place]
        if new and len(self.place) + len(new) > self.most:
            kept = np.flatnonzero(self.again)
            old = list(self.place)
            self._keep([old[k] for k in kept.tolist()], self.lists.take(pa.array(kept)))
            new = [w for w in dict.fromkeys(names) if w not in self.place]
        before = len(self.place)
        if new:
            self.place.update(zip(new, range(before, before + len(new)), strict=True))
            self.lists = pa.concat_arrays([self.lists, pa.array(self.learn(new), pa.list_(pa.int32()))])
        at = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        self.again[at[at < before]] = True
        self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        return at


class Codec:
    """Encoder and decoder of a tokenizers file, without special tokens added, truncation or padding."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        # the library's threads are bounded by the CPUs that Spark gives a task
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "2"))
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.by_run = _splits_at_blanks(spec) and spec.get("decoder") is None
        self.leaf = leaf
        if not self.by_run:
            return
        import regex

        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"\b\B")
        self.odd = "|".join([ODD, *(re.escape(t["content"]) for t in spec["added_tokens"])])
        self.splitter = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.tree = TreeEncoder(spec["model"], leaf, self.tok.model)
        self.known = _Known(self._learn, cache)
        names: list = [None] * self.tok.get_vocab_size(with_added_tokens=True)
        for name, i in self.tok.get_vocab(with_added_tokens=True).items():
            names[i] = name.encode()
        self.names = pa.array(names, pa.large_binary())
        self.decimal = pa.array([str(i).encode() for i in range(len(names))], pa.large_binary())
        self.byte = {b: c for b, c in enumerate(_byte_letters())}

    def _learn(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of pre-tokens: short ones by the model at once, longer ones by the tree."""
        spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(self.byte) for w in pretokens]
        model, leaf = self.tok.model, self.leaf
        out = [None if len(s) > leaf else [t.id for t in model.tokenize(s)] for s in spelt]
        long = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(long, self.tree.encode([spelt[k] for k in long]), strict=True):
            out[k] = ids
        return out

    def _odd(self, run: str) -> list[int]:
        """The ids of a run that the library's own normaliser and splitter must see."""
        if len(run) <= PLAIN_MOST and not self.added.search(run):
            return self.tok.encode(run, add_special_tokens=False).ids
        ids: list[int] = []
        at = 0
        for m in itertools.chain(self.added.finditer(run), [None]):
            part = run[at : m.start() if m else len(run)]
            for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)) if part else ():
                ids += self.tree.encode([piece])[0] if len(piece) > self.leaf else [t.id for t in self.tok.model.tokenize(piece)]
            if m:
                ids.append(self.tok.token_to_id(m[0]))
                at = m.end()
        return ids

    def _plain(self, runs: pa.Array) -> pa.Array:
        """The list of ids of each run that this class can normalise and split."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(runs)], pa.int32()), runs), pa.scalar("\n", pa.large_string()))[0].as_py()
        coded = pa.array(self.splitter.findall(joined.lower() + "\n"), pa.string()).dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        line = names.index("\n")
        end = np.flatnonzero(at == line)
        names[line] = names[0]  # no place is read for it
        place = self.known.places(names)[at[at != line]]
        lists = self.known.lists
        per = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy())[place])))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], per[end - np.arange(len(end))])).astype(np.int32)), lists.take(pa.array(place)).flatten())

    def _runs(self, runs: pa.Array) -> pa.Array:
        """The list of ids of each distinct run."""
        runs = runs.cast(pa.large_string())
        size = np.diff(np.frombuffer(runs.buffers()[1], np.int64)[runs.offset : runs.offset + len(runs) + 1])
        odd = pc.match_substring_regex(runs, self.odd).to_numpy(zero_copy_only=False) | (size > PLAIN_MOST)
        if not odd.any():
            return self._plain(runs)
        own = pa.array([self._odd(r) for r in runs.filter(pa.array(odd)).to_pylist()], pa.list_(pa.int32()))
        if odd.all():
            return own
        place = np.empty(len(runs), np.int64)
        place[~odd] = np.arange((~odd).sum())
        place[odd] = (~odd).sum() + np.arange(len(own))
        return pa.concat_arrays([self._plain(runs.filter(pa.array(~odd))), own]).take(pa.array(place))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts one after the other, and where each text's end (one more entry than texts, from 0)."""
        if not self.by_run:
            got = [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate(([0], np.cumsum([len(g) for g in got]))).astype(np.int64), np.array([i for g in got for i in g], np.int32)
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        word = ~SPACE[buf]
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        first = np.searchsorted(start, bounds)
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buf[word])]).dictionary_encode()
        lists = self._runs(coded.dictionary)
        size = np.diff(lists.offsets.to_numpy())[coded.indices.to_numpy()]
        ids = lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        return np.concatenate(([0], np.cumsum(size)))[first], ids

    def spell(self, ends: np.ndarray, ids: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """For each text its ids in decimal, and the decoded text, both joined by one space."""
        if not self.by_run:
            each = [ids[a:b].tolist() for a, b in itertools.pairwise(ends.tolist())]
            return [" ".join(map(str, e)).encode() for e in each], [self.tok.decode(e, skip_special_tokens=False).encode() for e in each]
        at, off = pa.array(ids), pa.array(ends.astype(np.int32))
        return tuple(pc.binary_join(pa.ListArray.from_arrays(off, t.take(at)), pa.scalar(b" ", pa.large_binary())).to_pylist() for t in (self.decimal, self.names))

    def pieces(self, texts: pa.Array, step: int):
        """Groups of (row, bytes) of about ``step`` bytes; a longer text comes in several pieces, cut at blanks where that is safe."""
        group, size = [], 0
        for row in range(len(texts)):
            text = texts[row].as_buffer() if texts[row].is_valid else pa.py_buffer(b"")
            at = 0
            while True:
                end = len(text)
                if self.by_run and end - at > 2 * step:
                    m = BLANK.search(text, at + step)
                    end = m.end() if m else end
                group.append((row, bytes(memoryview(text)[at:end])))
                size += end - at
                at = end
                if size >= step:
                    yield group
                    group, size = [], 0
                if at >= len(text):
                    break
        if group:
            yield group


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: the printable ones of Latin-1 for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    more = itertools.count(0x100)
    return [chr(b) if b in own else chr(next(more)) for b in range(256)]


def _splits_at_blanks(spec: dict) -> bool:
    """Is it sure that no token spans white space and that pre-tokens can be encoded apart?"""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    # a removing split by a pattern that never takes white space, then letters for bytes
    rest = "[^\\s\\p{L}\\p{N}]+"
    pattern = pre[0].get("pattern", {}).get("Regex", "")
    removes = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and pattern.endswith(rest) and "\\s" not in pattern[: -len(rest)]
    letters = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    plain = all(not re.search(r"\s", t["content"]) and not any(t[k] for k in ("lstrip", "rstrip", "single_word", "normalized")) for t in spec["added_tokens"])
    model = spec["model"]
    if not (known and removes and letters and plain and model["type"] == "BPE" and spec.get("post_processor") is None):
        return False
    suffix = model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    # no letters of a text may make up the suffix
    clear = all((a + b).endswith(suffix) == b.endswith(suffix) for a, b in merges) if suffix else True
    return clear and not any(model.get(k) for k in ("byte_fallback", "unk_token", "dropout", "continuing_subword_prefix", "ignore_merges"))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a tokenizer file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", step: int = STEP, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) for every whole text.

    ``path``: a tokenizer file that every executor can read.  ``with_ids``
    adds the ids, ``with_text`` the decoded text.  Null and empty texts have no
    ids; repeated rows give repeated rows; an empty table gives an empty one;
    ``row`` is a struct, so columns of any name pass through.  A long text is
    handled in pieces of about ``step`` bytes, cut at blanks.
    """
    bounded_batches(docs.sparkSession)
    kind = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        kind["ids"] = "array<int>"
    if with_text:
        kind["decoded"] = "string"

    @F.arrow_udf(", ".join(f"{n} {t}" for n, t in kind.items()))
    def coded(texts: pa.Array) -> pa.Array:
        own, n = codec(path), len(texts)
        count = np.zeros(n, np.int64)
        sums: list = [None] * n
        flat, decoded = [np.zeros(0, np.int32)], [[] for _ in range(n if with_text else 0)]
        for group in own.pieces(texts, step):
            ends, ids = own.encode([t for _, t in group])
            for (row, _), a, b, *both in zip(group, ends[:-1].tolist(), ends[1:].tolist(), *own.spell(ends, ids), strict=True):
                sums[row] = sums[row] or (hashlib.sha256(), hashlib.sha256())
                for h, x in zip(sums[row], both, strict=True):
                    h.update(b" " + x if count[row] and b > a else x)
                if with_text and b > a:
                    decoded[row].append(both[1])
                count[row] += b - a
            if with_ids:
                flat.append(ids)
        cols = [pa.array(count), *(pa.array([s[k].hexdigest() for s in sums], pa.string()) for k in (0, 1))]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(np.concatenate(flat), pa.int32())))
        if with_text:
            cols.append(pa.array([b" ".join(d).decode() for d in decoded], pa.string()))
        return pa.StructArray.from_arrays(cols, list(kind))

    own_rows = docs.select(F.struct("*").alias("row"))
    return own_rows.select("row", coded(F.col("row")[text_col].cast("binary")).alias("c")).select("row", "c.*")
