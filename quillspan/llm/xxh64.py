"""XXH64 of many byte runs at once, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: The five primes of XXH64 (fixed values of the published algorithm).
P1 = U64(11400714785074694791)
P2 = U64(14029467366897019727)
P3 = U64(1609587929392839161)
P4 = U64(9650029242287828579)
P5 = U64(2870177450012600261)
#: Runs longer than this, and lengths with few runs, are hashed one by one.
LONG, FEW = 160, 12


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def windows64(buf: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit word that begins at each byte of ``buf`` (zero-padded)."""
    n = len(buf)
    m = (n + 15) // 8 * 8
    padded = np.zeros(m + 8, np.uint8)
    padded[:n] = buf
    out = np.empty(m, U64)
    for j in range(8):
        out[j::8] = np.frombuffer(padded.data, "<u8", m // 8, j)
    return out


def xxh64_runs(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """XXH64 of buf[start : start + length] for each run; ``at``: windows64(buf), if it is known."""
    out = np.empty(len(start), U64)
    if not len(start):
        return out
    at = windows64(buf) if at is None else at
    key = np.minimum(length, LONG + 1).astype(np.int16)
    order = np.argsort(key, kind="stable")
    bounds = np.searchsorted(key[order], np.arange(LONG + 2))
    for n in range(LONG + 2):
        lo, hi = bounds[n], bounds[n + 1] if n <= LONG else len(order)
        if hi == lo:
            continue
        idx = order[lo:hi]
        if n > LONG or hi - lo < FEW:
            raw = buf.tobytes() if n > LONG and hi - lo > 64 else buf
            out[idx] = [xxhash.xxh64_intdigest(bytes(raw[s : s + m]), seed) for s, m in zip(start[idx].tolist(), length[idx].tolist(), strict=True)]
        else:
            out[idx] = _same_length(at, start[idx], n, U64(seed))
    return out


def _same_length(at: np.ndarray, start: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        p = 0
        if n >= 32:
            acc = [np.full(len(start), seed + P1 + P2, U64), np.full(len(start), seed + P2, U64), np.full(len(start), seed, U64), np.full(len(start), seed - P1, U64)]
            while p + 32 <= n:
                for k in range(4):
                    acc[k] = _round(acc[k], at[start + (p + 8 * k)])
                p += 32
            h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                h = (h ^ _round(U64(0), a)) * P1 + P4
        else:
            h = np.full(len(start), seed + P5, U64)
        h += U64(n)
        while p + 8 <= n:
            h = _rot(h ^ _round(U64(0), at[start + p]), 27) * P1 + P4
            p += 8
        if p + 4 <= n:
            h = _rot(h ^ (at[start + p] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
            p += 4
        while p < n:
            h = _rot(h ^ (at[start + p] & U64(0xFF)) * P5, 11) * P1
            p += 1
        h = (h ^ (h >> U64(33))) * P2
        h = (h ^ (h >> U64(29))) * P3
        return h ^ (h >> U64(32))
