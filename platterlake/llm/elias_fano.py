"""Elias-Fano sequences and a two-level n-gram trie of them, in memory-mapped files.

A sequence of n non-decreasing integers below u keeps the low bits of each value
packed, and the high parts as a bit vector with one set bit a value and one clear
bit a step: about 2 + log2(u / n) bits a value.  Counts of bits by 64-bit word are
the only index.  All lookups take arrays of queries.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np


def _select(words: np.ndarray, cumulative: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
    """Position of the rank-th set (or clear) bit; ``cumulative`` counts such bits before each word."""
    at = np.searchsorted(cumulative, rank, "right") - 1
    word = words[at]
    if flip:
        word = ~word
    left = (rank - cumulative[at]).astype(np.int64)
    place = np.zeros(len(rank), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        low = (word >> place.astype(np.uint64)) & np.uint64((1 << step) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        over = left >= n
        left -= np.where(over, n, 0)
        place += np.where(over, step, 0)
    return at * 64 + place


class EliasFano:
    """Read side; :meth:`write` makes the files."""

    def __init__(self, folder: Path, name: str):
        about = json.loads((folder / f"{name}.json").read_text())
        self.n, self.bits = about["n"], about["bits"]
        load = lambda part, kind: np.memmap(folder / f"{name}.{part}", kind, "r") if about["n"] else np.empty(0, kind)
        self.low, self.words = load("low", np.uint8), load("high", np.uint64)
        self.ones, self.zeros = load("ones", np.int64), load("zeros", np.int64)

    @staticmethod
    def write(folder: Path, name: str, values: np.ndarray, universe: int) -> None:
        """Store non-decreasing ``values`` below ``universe``."""
        n = len(values)
        bits = max(int(universe // max(n, 1)).bit_length() - 1, 0)
        (folder / f"{name}.json").write_text(json.dumps({"n": n, "bits": bits}))
        if not n:
            return
        values = values.astype(np.uint64)
        size = n + (int(universe) >> bits) + 2
        mark = np.zeros(-(-size // 64) * 64, np.uint8)
        mark[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        words = np.packbits(mark, bitorder="little").view(np.uint64)
        low = np.zeros(-(-n * bits // 8) + 8, np.uint8)
        for i in range(0, n, 1 << 18):  # a slice at a time keeps the unpacked bits small; slices begin at whole bytes
            part = values[i : i + (1 << 18)]
            each = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
            packed = np.packbits(each.reshape(-1), bitorder="little")
            low[i * bits // 8 : i * bits // 8 + len(packed)] = packed
        set_ = np.bitwise_count(words).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(set_)[:-1]])
        zeros = np.concatenate([[0], np.cumsum(64 - set_)[:-1]])
        for part, x in (("low", low), ("high", words), ("ones", ones), ("zeros", zeros)):
            x.tofile(folder / f"{name}.{part}")

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        every = np.ndarray(len(self.low) - 7, "<u8", self.low, strides=(1,))
        return (every[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        high = _select(self.words, self.ones, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= x (within first..end), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> np.uint64(self.bits)).astype(np.int64)
        # Values of one high part lie between two clear bits.
        lo = np.where(high > 0, _select(self.words, self.zeros, np.maximum(high - 1, 0), True) - high + 1, 0)
        hi = _select(self.words, self.zeros, high, True) - high
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        top, want = hi.copy(), x & np.uint64((1 << self.bits) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self._low(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        hit = lo < top
        hit[hit] = self._low(lo[hit]) == want[hit]
        return lo, hit


class Trie:
    """Contexts, pointers to their successors, and a quantised value for each (context, successor).

    Successors are numbers below ``width``; the second level holds context rank *
    width + successor, which is monotone, and a context's pointer range limits the
    search to its own successors.  Values are stored in 16 bits between the least and
    the greatest.
    """

    LEVELS = (1 << 16) - 1

    def __init__(self, folder: Path):
        about = json.loads((folder / "trie.json").read_text())
        self.width, self.lo, self.step = about["width"], about["lo"], about["step"]
        self.contexts, self.pointers, self.successors = (EliasFano(folder, x) for x in ("contexts", "pointers", "successors"))
        self.values = np.memmap(folder / "values", np.uint16, "r") if self.successors.n else np.empty(0, np.uint16)

    @staticmethod
    def write(folder: Path, contexts: np.ndarray, universe: int, rank: np.ndarray, successor: np.ndarray, width: int, values: np.ndarray) -> None:
        """``contexts`` ascending below ``universe``; entries sorted by (rank of context, successor)."""
        lo, hi = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        step = (hi - lo) / Trie.LEVELS or 1.0
        (folder / "trie.json").write_text(json.dumps({"width": int(width), "lo": lo, "step": step}))
        EliasFano.write(folder, "contexts", contexts, universe)
        EliasFano.write(folder, "pointers", np.searchsorted(rank, np.arange(len(contexts) + 1)), len(rank) + 1)
        EliasFano.write(folder, "successors", rank.astype(np.uint64) * np.uint64(width) + successor.astype(np.uint64), max(len(contexts) * int(width), 1))
        np.rint((values - lo) / step).astype(np.uint16).tofile(folder / "values")

    def lookup(self, contexts: np.ndarray, at: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of (contexts[at], successor), and whether the trie has them."""
        value, found = np.zeros(len(at)), np.zeros(len(at), bool)
        if not self.successors.n:
            return value, found
        rank, known = self.contexts.successor(contexts)
        safe = np.where(known, rank, 0)
        first, end = self.pointers.access(safe).astype(np.int64), self.pointers.access(safe + 1).astype(np.int64)
        some = np.flatnonzero(known[at])
        own = at[some]
        key = rank[own].astype(np.uint64) * np.uint64(self.width) + successor[some].astype(np.uint64)
        place, hit = self.successors.successor(key, first[own], end[own])
        found[some[hit]] = True
        value[some[hit]] = self.lo + self.step * self.values[place[hit]]
        return value, found
