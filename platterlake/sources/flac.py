"""Frames of the free lossless audio codec (RFC 9639), as containers keep them: without a stream header."""

from __future__ import annotations

import numpy as np


class Bits:
    """Big-endian bits of ``data``; reading past the end raises ``EOFError``."""

    def __init__(self, data: bytes):
        self.text, self.at = f"{int.from_bytes(data, 'big'):0{len(data) * 8}b}" if data else "", 0

    def take(self, n: int) -> int:
        end = self.at + n
        if end > len(self.text):
            raise EOFError("bits end early")
        out = int(self.text[self.at : end], 2) if n else 0
        self.at = end
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Number of clear bits before the next set one, which is taken too."""
        one = self.text.find("1", self.at)
        if one < 0:
            raise EOFError("bits end early")
        n, self.at = one - self.at, one + 1
        return n

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    wide = 4 + bits.take(2)
    if wide > 5:
        raise ValueError("unknown coding of residuals")
    parts = 1 << bits.take(4)
    out: list[int] = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = bits.take(wide)
        if k == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            x = bits.unary() << k | bits.take(k)
            out.append(x >> 1 ^ -(x & 1))
    return out


#: Coefficients of the fixed predictors, the latest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    if bits.take(1):
        raise ValueError("subframe does not begin with a clear bit")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            out.append(r + (sum(w * out[-1 - i] for i, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("reserved kind of subframe")
    return np.array(out, np.int64) << wasted


def _frame(bits: Bits) -> np.ndarray:
    """Samples of one frame, a column a channel."""
    if bits.take(14) != 0x3FFE:
        raise ValueError("frame does not begin with its mark")
    bits.take(2)
    size_code, rate_code, channels, depth_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    bits.take(1)
    more = bits.take(8)  # the frame's number, coded like a character
    while more & 0x80 and more & 0x40:
        bits.take(8)
        more = more << 1 & 0xFF
    if size_code in (6, 7):
        size = bits.take(8 * (size_code - 5)) + 1
    elif size_code:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    else:
        raise ValueError("reserved size of block")
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    bits.take(8)  # checksum of the header
    depth = {0: 16, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(depth_code)
    if depth is None or channels > 10:
        raise ValueError("reserved sample size or channels")
    side = {8: 1, 9: 0, 10: 1}.get(channels)
    x = [_subframe(bits, size, depth + (i == side)) for i in range(2 if channels > 7 else channels + 1)]
    bits.align()
    bits.take(16)  # checksum of the frame
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        mid = x[0] << 1 | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x, 1)


def decode(data: bytes, samples: int) -> tuple[np.ndarray, int]:
    """The first ``samples`` samples, a column a channel, and how many bytes their frames take."""
    bits, out, n = Bits(data), [], 0
    while n < samples:
        out.append(_frame(bits))
        n += len(out[-1])
    return (np.concatenate(out)[:samples] if out else np.empty((0, 2), np.int64)), bits.at // 8
