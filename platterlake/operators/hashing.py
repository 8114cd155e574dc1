"""Digests of images that are rows of chunks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.checksums import has_md5, has_sha1


def _crc_shift(crc: int, zeros: int) -> int:
    """CRC-32 register after ``zeros`` zero bytes, by squaring the matrix of one zero bit."""
    times = lambda m, v: _xor_rows(m, v)
    bit = [0xEDB88320] + [1 << i for i in range(31)]
    matrix, n = bit, zeros * 8
    while n:
        if n & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, row) for row in matrix]
        n >>= 1
    return crc


def _xor_rows(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_join(first: int, second: int, second_length: int) -> int:
    """CRC-32 of two pieces put together, from those of the pieces."""
    return _crc_shift(first, second_length) ^ second


def _zero_tables(power: int) -> np.ndarray:
    """What 2 ** ``power`` zero bytes make of a register, by its four bytes."""
    if power not in _TABLES:
        column = [_crc_shift(1 << i, 1 << power) for i in range(32)]
        _TABLES[power] = np.array([[_xor_rows(column[8 * k : 8 * k + 8], b) for b in range(256)] for k in range(4)], np.uint32)
    return _TABLES[power]


_TABLES: dict[int, np.ndarray] = {}


def crc32_join_all(crcs: np.ndarray, lengths: np.ndarray) -> int:
    """CRC-32 of all pieces put together in order: neighbours are joined, level by level."""
    crc, n = crcs.astype(np.uint32), lengths.astype(np.int64)
    while len(crc) > 1:
        if len(crc) % 2:
            crc, n = np.append(crc, np.uint32(0)), np.append(n, 0)  # no bytes have CRC 0
        first, second = crc[::2].copy(), n[1::2]
        for power in range(int(second.max()).bit_length()):
            at = np.flatnonzero((second >> power) & 1)
            t, v = _zero_tables(power), first[at]
            first[at] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
        crc, n = first ^ crc[1::2], n[::2] + second
    return int(crc[0]) if len(crc) else 0


def _digest(mode: str):
    def run(key: tuple[pa.Scalar, ...], chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("seq")
        crc, size = 0, 0
        sha = hashlib.sha1() if has_sha1(mode) else None
        md5 = hashlib.md5() if has_md5(mode) else None
        for piece in chunks.column("data"):
            data = piece.as_py() or b""
            crc, size = zlib.crc32(data, crc), size + len(data)
            for h in (sha, md5):
                if h:
                    h.update(data)
        return pa.table({"path": [key[0].as_py()], "crc32": [f"{crc:08x}"], "sha1": pa.array([sha and sha.hexdigest()], pa.string()), "md5": pa.array([md5 and md5.hexdigest()], pa.string()), "data_size": [size]})

    return run


def chunked_hashes(chunks: DataFrame, mode: str = "All") -> DataFrame:
    """Per path: digests of its chunks (path, seq, data) in order, and the bytes hashed.

    CRC-32 joins, so with mode ``Crc32`` it is a partial aggregate of any number of
    chunks.  SHA-1 and MD5 must see a file's bytes in order, in one task a file; files
    run in parallel.
    """
    if mode == "Crc32":
        return mergeable_crc32(chunks).select("path", "crc32", F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("string").alias("md5"), "data_size")
    return chunks.select("path", "seq", "data").groupBy("path").applyInArrow(_digest(mode), "path string, crc32 string, sha1 string, md5 string, data_size bigint")


def _join_crcs(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("seq")
    n = parts.column("n").to_numpy()
    crc, size = crc32_join_all(parts.column("crc").to_numpy(), n), int(n.sum())
    return pa.table({"path": [key[0].as_py()], "crc32": [f"{crc:08x}"], "data_size": [size]})


def mergeable_crc32(chunks: DataFrame) -> DataFrame:
    """CRC-32 per path where only each chunk's own CRC and length are shuffled, not its bytes."""
    data = F.coalesce("data", F.lit(b""))
    parts = chunks.select("path", "seq", F.crc32(data).alias("crc"), F.length(data).cast("bigint").alias("n"))
    return parts.groupBy("path").applyInArrow(_join_crcs, "path string, crc32 string, data_size bigint")


def with_progress(chunks: DataFrame, name: str = "hashing") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of how many chunks and bytes have passed (``get`` waits for the end of the action).

    In a stream, the same metrics reach listeners with every micro-batch.
    """
    seen = Observation(name)
    rows = chunks.observe(seen, F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.length("data").cast("bigint")), F.lit(0)).alias("bytes"))
    return rows, seen
