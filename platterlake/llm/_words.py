"""Vectorised words, lines and shingles over Arrow blocks of UTF-8 text.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the
regular expression ``[^\\x20\\x09-\\x0D]+`` on UTF-8.  Words and lines get 64-bit
hashes: a polynomial over the bytes modulo 2**64 with an odd base, taken from
prefix sums (so that one pass serves every word of a block), and then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POW: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = (np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bytes that are hashed at once; a longer word is hashed alone.
SEGMENT = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POW.get("up", ())):
        size = max(n, SEGMENT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POW[name] = np.multiply.accumulate(out)
    return _POW["up"], _POW["down"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[start[i]:end[i]]`` for ascending spans that do not overlap."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(end, start[at] + SEGMENT, "right")), at + 1)
        lo, hi = int(start[at]), int(end[to - 1])
        up, down = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


class Words:
    """Words of a block: ``doc`` (row in the block), ``start``, ``end``, ``count`` per row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.off = off
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~SPACE[data]
        cut = np.zeros(n + 2, bool)
        cut[off + 1] = True  # a word never crosses rows
        now, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(now & (~before | cut[1:]))
        self.end = np.flatnonzero(before & (~now | cut[1:]))
        self.inside = inside[1:-1]
        at = np.searchsorted(self.start, off)
        self.first = at[:-1]
        self.count = np.diff(at)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def windows(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a row, and the index of each window's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h + words[i : i + n])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return h[at], at


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set entries of ``mask`` between consecutive offsets."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the \\n-split lines; an empty row has one empty line."""
    breaks = np.flatnonzero(data == 10)
    # Boundaries: each row's start, and the byte after each line feed.
    start = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end[:-1] = start[1:] - 1
    end[last] = off[row[last] + 1]
    return start, end, row
