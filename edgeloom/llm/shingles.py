"""Shingle hashes of whole texts, for many texts at once.

Words are runs of bytes without white space, A-Z lower-cased; a word's hash is a polynomial in its
bytes with its length mixed in, a shingle's hash combines k of them in order. Everything is vectorised over
a batch, so a text costs a few array passes however long it is.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_SPARE = [np.array([1], dtype=np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_SPARE[0]) < n:
        p = np.full(max(n, 2 * len(_SPARE[0])), _BASE, dtype=np.uint64)
        p[0] = 1
        _SPARE[0] = np.cumprod(p, dtype=np.uint64)
    return _SPARE[0]


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a byte array."""
    solid = ~_BLANK[raw]
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    at = np.flatnonzero(solid)
    size = stop - start
    first = np.cumsum(size) - size
    rel = np.arange(len(at)) - np.repeat(first, size)
    upper = (raw >= 65) & (raw <= 90)
    low = np.where(upper, raw + np.uint8(32), raw)[at].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(_mix(low * _BASE) * _powers(int(size.max()) + 1)[rel], first)
    return _mix(h + size.astype(np.uint64) * _M2), start


def shingle_sets(texts: list[str | None], k: int, budget: int = 1 << 18) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle of them all.

    ``budget``: bytes of text that are worked on at once (a longer text is one batch of its own).
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if group and held + len(b) > budget:
            out += _sets(group, k)
            group, held = [], 0
        group.append(b)
        held += len(b)
    return out + _sets(group, k)


def _sets(group: list[bytes], k: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(group), dtype=np.uint8)
    ends = np.cumsum([len(b) + 1 for b in group])
    words, start = _word_hashes(raw)
    cut = np.concatenate([[0], np.searchsorted(start, ends)])
    n = len(words) - k + 1
    long = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        long = _mix(long * _BASE + words[j : j + n])
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= k:
            out.append(np.unique(long[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                h = _mix(h * _BASE + w)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


class Minima:
    """Many universal hash minima (multiply-add modulo 2^64, upper bits) of shingle sets, in bands."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        draw = np.random.Generator(np.random.PCG64(seed))
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, n, dtype=np.uint64)

    def signature(self, shingles: np.ndarray, chunk: int = 4096) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        for i in range(0, len(shingles), chunk):
            x = shingles[i : i + chunk]
            h = self.a[:, None] * x[None, :]
            h += self.b[:, None]
            np.minimum(best, h.min(axis=1), out=best)
        return (best >> np.uint64(32)).astype(np.uint32)

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """One long a band, of its rows of the signature and its number."""
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in signature.reshape(self.bands, self.rows).T:
            h = _mix(h * _BASE + row.astype(np.uint64))
        return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes, neither empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
