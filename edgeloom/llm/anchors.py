"""Anchors and pieces of byte strings: how equal windows of different documents meet.

Every window of ``length`` bytes names one k-gram of itself, the one with the least hash (the first of
equals), as its anchor; equal windows name equal anchors at equal places. Consecutive windows with
one anchor make a piece, at most 2 * length - k bytes long. So all occurrences of a window lie in pieces
of one anchor hash, and pieces are about (length - k) / 2 windows each.
"""

from __future__ import annotations

import numpy as np

from edgeloom.llm.shingles import _mix

_BASE = 0xD6E8FEB86659FD93
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLES: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_TABLES[0][0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, np.uint64(_BASE)), np.full(n, _BACK)
        up[0] = down[0] = 1
        _TABLES[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _TABLES[0]


class Strings:
    """Hashes of any substring of a byte array, by prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def _first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the index of its least, the first of equals."""
    at = np.arange(len(h), dtype=np.int32)
    best, have = at, 1

    def join(shift: int) -> np.ndarray:
        a, b = best[: len(best) - shift], best[shift:]
        return np.where(h[b] < h[a], b, a)

    while 2 * have <= width:
        best, have = join(have), 2 * have
    return join(width - have) if have < width else best


def pieces(raw: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Pieces of the documents in ``raw`` that end at ``ends``: (start, windows, anchor hash, content hash).

    ``start`` is the first window's place in ``raw``, ``windows`` how many consecutive ones the piece has.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none
    strings = Strings(raw)
    h = strings.grams(k)
    anchor = _first_minima(h, length - k + 1)  # one a window, over document bounds too
    begins = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(anchor) + 1, dtype=np.int32)
    ok = ends - begins >= length
    np.add.at(inside, begins[ok], 1)
    np.add.at(inside, np.minimum(ends[ok] - length + 1, len(anchor)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = begins[ok]
    new[first[first < len(new)]] = True
    start = np.flatnonzero(new)
    count = np.cumsum(inside)
    total = count[-1] if len(count) else 0
    before = count[start] - 1
    windows = np.diff(np.append(before, total))
    place = anchor[start] - start
    stop = start + windows + length - 1
    shape = _mix((windows.astype(np.uint64) << np.uint64(20)) | place.astype(np.uint64))
    content = _mix(strings.hashes(start, stop) ^ shape)
    return start, windows, h[anchor[start]].view(np.int64), content.view(np.int64)
