"""Reader for compressed-hunk disc containers, version 5: header, metadata, hunks.

Hunks may be stored plainly or, in a compressed container, plainly, as copies of other
hunks, or by zlib, LZMA, FLAC or (where the ``zstandard`` package is installed) zstd
and their CD forms.  Huffman and other codecs are reported as unsupported, as are
containers with a parent.  Numbers in the file are big-endian.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from ..constants import CD_SYNC, CHD_MAGIC, RAW_SECTOR
from . import flac

try:
    import zstandard
except ImportError:  # a codec that few containers use
    zstandard = None

SUBCODE = 96
HEADER_V5 = 124


class ChdError(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass
class Header:
    version: int
    codecs: tuple[str, ...]
    logical_bytes: int
    map_at: int
    meta_at: int
    hunk_bytes: int
    unit_bytes: int
    has_parent: bool

    @property
    def hunks(self) -> int:
        return -(-self.logical_bytes // self.hunk_bytes)


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ChdError("CorruptedHeader", "container ends early")
    return data


def read_header(f) -> Header:
    f.seek(0)
    start = f.read(16)
    if len(start) < 16 or start[:8] != CHD_MAGIC:
        raise ChdError("InvalidFormat", "not a compressed-hunk container")
    size, version = struct.unpack(">II", start[8:])
    if version != 5 or size != HEADER_V5:
        raise ChdError("UnsupportedVariant", f"container version {version}")
    rest = _exactly(f, HEADER_V5 - 16)
    *codecs, logical, map_at, meta_at, hunk, unit = struct.unpack(">4I3Q2I", rest[:48])
    if not hunk or not unit or hunk % unit:
        raise ChdError("CorruptedHeader", "hunks are not whole units")
    names = tuple(struct.pack(">I", c).decode("latin-1") if c else "" for c in codecs)
    return Header(version, names, logical, map_at, meta_at, hunk, unit, any(rest[88:108]))


def read_metadata(f, header: Header) -> Iterator[tuple[str, bytes]]:
    """Tags and values, in the order of their list."""
    at, seen = header.meta_at, set()
    while at and at not in seen:
        seen.add(at)
        f.seek(at)
        tag, sized, following = struct.unpack(">4sIQ", _exactly(f, 16))
        yield tag.decode("latin-1"), _exactly(f, sized & 0xFFFFFF)
        at = following


class _Bits(flac.Bits):
    def take(self, n: int) -> int:
        try:
            return super().take(n)
        except EOFError as e:
            raise ChdError("CorruptedHeader", "hunk map ends early") from e


def _prefix_codes(bits: _Bits) -> dict[tuple[int, int], int]:
    """Canonical codes of 16 symbols, of up to 8 bits, from run-length coded code lengths."""
    lengths: list[int] = []
    while len(lengths) < 16:
        n = bits.take(4)
        if n != 1:
            lengths.append(n)
            continue
        n = bits.take(4)
        if n == 1:
            lengths.append(1)
        else:
            lengths += [n] * (bits.take(4) + 3)
    codes, start = {}, 0
    for size in range(8, 0, -1):  # longer codes come first
        first = start
        for symbol, n in enumerate(lengths[:16]):
            if n == size:
                codes[size, first] = symbol
                first += 1
        if size > 1 and first & 1:
            raise ChdError("CorruptedHeader", "hunk map has impossible codes")
        start = first >> 1
    return codes


def _symbol(bits: _Bits, codes: dict[tuple[int, int], int]) -> int:
    code = 0
    for size in range(1, 9):
        code = code << 1 | bits.take(1)
        if (size, code) in codes:
            return codes[size, code]
    raise ChdError("CorruptedHeader", "hunk map has an unknown code")


#: Kinds of hunks in a compressed map: four codecs, then stored, a copy of a hunk of this file, one of the parent's;
#: then shorthands that only the map itself uses.
STORED, SELF, PARENT, RUN_SHORT, RUN_LONG, SELF_SAME, SELF_NEXT, PARENT_SELF, PARENT_SAME, PARENT_NEXT = 4, 5, 6, 7, 8, 9, 10, 11, 12, 13


class Hunks:
    """Hunks by number; the map is read once."""

    def __init__(self, f, header: Header):
        self.f, self.header = f, header
        if header.has_parent:
            raise ChdError("UnsupportedVariant", "container needs its parent")
        self.map = self._stored_map() if not header.codecs[0] else self._packed_map()

    def _stored_map(self) -> list[tuple[int, int, int]]:
        self.f.seek(self.header.map_at)
        n, size = self.header.hunks, self.header.hunk_bytes
        return [(STORED, x * size, size if x else 0) for x in struct.unpack(f">{n}I", _exactly(self.f, 4 * n))]

    def _packed_map(self) -> list[tuple[int, int, int]]:
        self.f.seek(self.header.map_at)
        n, first, _, size_bits, self_bits, parent_bits, _ = struct.unpack(">I6sHBBBB", _exactly(self.f, 16))
        bits = _Bits(_exactly(self.f, n))
        codes = _prefix_codes(bits)
        kinds: list[int] = []
        last = 0
        while len(kinds) < self.header.hunks:
            kind = _symbol(bits, codes)
            if kind == RUN_SHORT:
                kinds += [last] * (3 + _symbol(bits, codes))
            elif kind == RUN_LONG:
                kinds += [last] * (3 + 16 + (_symbol(bits, codes) << 4) + _symbol(bits, codes))
            else:
                kinds.append(last := kind)
        out, at, of_self = [], int.from_bytes(first, "big"), 0
        for kind in kinds[: self.header.hunks]:
            if kind < STORED:
                size = bits.take(size_bits)
                bits.take(16)  # checksum of the hunk
                out.append((kind, at, size))
                at += size
            elif kind == STORED:
                bits.take(16)
                out.append((STORED, at, self.header.hunk_bytes))
                at += self.header.hunk_bytes
            elif kind in (SELF, SELF_SAME, SELF_NEXT):
                of_self = bits.take(self_bits) if kind == SELF else of_self + (kind == SELF_NEXT)
                out.append((SELF, of_self, 0))
            else:
                raise ChdError("UnsupportedVariant", "container needs its parent")
        return out

    def read(self, i: int) -> bytes:
        kind, at, size = self.map[i]
        if kind == SELF:
            return self.read(at)
        if not size:
            return bytes(self.header.hunk_bytes)  # never written
        self.f.seek(at)
        data = _exactly(self.f, size)
        return data if kind == STORED else self._unpack(self.header.codecs[kind], data)

    def _unpack(self, codec: str, data: bytes) -> bytes:
        size = self.header.hunk_bytes
        try:
            if codec in ("zlib", "lzma") or codec == "zstd" and zstandard:
                return _plain(codec, data, size)
            if codec in ("cdzl", "cdlz") or codec == "cdzs" and zstandard:
                return self._unpack_cd(codec, data)
            if codec == "flac":
                if data[:1] not in (b"L", b"B"):
                    raise ValueError("unknown order of bytes")
                return _audio(data[1:], size, "<i2" if data[:1] == b"L" else ">i2")[0]
            if codec == "cdfl":
                return self._unpack_audio(data)
        except (zlib.error, lzma.LZMAError, EOFError, ValueError, *([zstandard.ZstdError] if zstandard else [])) as e:
            raise ChdError("CorruptedHeader", f"hunk cannot be decompressed: {e}") from e
        raise ChdError("UnsupportedVariant", f"codec {codec!r}")

    def _unpack_cd(self, codec: str, data: bytes) -> bytes:
        """Sectors and their subcode are packed apart; a bit a sector says that its sync and parity are to be rebuilt."""
        frames = self.header.hunk_bytes // (RAW_SECTOR + SUBCODE)
        flags = -(-frames // 8)
        wide = 3 if self.header.hunk_bytes >= 65536 else 2
        n = int.from_bytes(data[flags : flags + wide], "big")
        at = flags + wide
        sectors = _plain({"cdzl": "zlib", "cdlz": "lzma", "cdzs": "zstd"}[codec], data[at : at + n], frames * RAW_SECTOR)
        subcode = _plain("zstd" if codec == "cdzs" else "zlib", data[at + n :], frames * SUBCODE)
        out = bytearray()
        for i in range(frames):
            sector = bytearray(sectors[i * RAW_SECTOR : (i + 1) * RAW_SECTOR])
            if data[i // 8] >> (i % 8) & 1:
                sector[:12] = CD_SYNC
                write_parity(sector)
            out += sector + subcode[i * SUBCODE : (i + 1) * SUBCODE]
        return bytes(out)


    def _unpack_audio(self, data: bytes) -> bytes:
        """Sectors as FLAC frames of big-endian stereo samples, then their subcode."""
        frames = self.header.hunk_bytes // (RAW_SECTOR + SUBCODE)
        sectors, n = _audio(data, frames * RAW_SECTOR, ">i2")
        subcode = _plain("zlib", data[n:], frames * SUBCODE)
        return b"".join(sectors[i * RAW_SECTOR : (i + 1) * RAW_SECTOR] + subcode[i * SUBCODE : (i + 1) * SUBCODE] for i in range(frames))


def _audio(data: bytes, size: int, kind: str) -> tuple[bytes, int]:
    """``size`` bytes of 16-bit stereo samples, and how many bytes of ``data`` hold them."""
    samples, n = flac.decode(data, size // 4)
    if samples.shape[1:] != (2,):
        raise ValueError("audio is not stereo")
    return samples.astype(kind).tobytes(), n


def _plain(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        out = zlib.decompressobj(-15).decompress(data, size)
    elif codec == "zstd":
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    else:  # raw LZMA1 with the codec's usual settings for a buffer of this size
        reduced = next((x for k in range(11, 31) for x in (2 << k, 3 << k) if size <= x), 1 << 26)
        filters = [{"id": lzma.FILTER_LZMA1, "dict_size": min(reduced, 1 << 26), "lc": 3, "lp": 0, "pb": 2}]
        out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)
    if len(out) != size:
        raise ChdError("CorruptedHeader", "hunk is not as long as it should be")
    return out


def _gf_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of GF(2**8) with polynomial 0x11D: twice each value, and the value whose double and itself add to each."""
    double = np.array([(i << 1) ^ (0x11D if i & 0x80 else 0) for i in range(256)], np.uint8)
    back = np.zeros(256, np.uint8)
    back[np.arange(256) ^ double] = np.arange(256)
    return double, back


_DOUBLE, _BACK = _gf_tables()


def _places(majors: int, minors: int, major_step: int, minor_step: int) -> np.ndarray:
    """Which byte of the protected part is the i-th of each vector: a row a vector."""
    major, minor = np.arange(majors)[:, None], np.arange(minors)
    return ((major >> 1) * major_step + (major & 1) + minor * minor_step) % (majors * minors)


_P, _Q = _places(86, 24, 2, 86), _places(52, 43, 86, 88)


def _parity(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Reed-Solomon parity (ECMA-130) of the protected bytes: two bytes for each vector."""
    rows = data[places]
    one = np.zeros(len(rows), np.uint8)
    for i in range(rows.shape[1]):
        one = _DOUBLE[one ^ rows[:, i]]
    two = np.bitwise_xor.reduce(rows, 1)
    one = _BACK[_DOUBLE[one] ^ two]
    return np.concatenate([one, one ^ two])


def write_parity(sector: bytearray) -> None:
    """P and Q parity of a sector; a mode 2 sector counts its address as zero."""
    data = np.frombuffer(bytes(sector), np.uint8).copy()
    if sector[15] == 2:
        data[12:16] = 0
    data[0x81C : 0x81C + 172] = _parity(data[12:], _P)
    data[0x8C8 : 0x8C8 + 104] = _parity(data[12:], _Q)
    sector[0x81C:] = data[0x81C:].tobytes()
