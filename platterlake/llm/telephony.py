"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM, and resampled PCM.

Companded samples are expanded by 256-entry tables; ADPCM blocks are decoded with
numpy across all blocks of an Arrow batch at once (each block restarts its
predictor, so a step of the loop handles one sample of every block).  PCM is
resampled by a whole factor with linear interpolation that keeps the original
samples, and stored as 16-bit WAV.

Defined results: a null payload is an empty one; an empty payload decodes to no
samples; an incomplete ADPCM block at the end is padded with zero bytes; repeated
rows get equal results; other columns are ignored; an empty table gives an empty
result.  Payloads are never cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_blocks, utf8

#: Fixed values of IMA ADPCM (public standard).
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], np.int32)
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def ulaw_table() -> np.ndarray:
    """16-bit value of each mu-law code (G.711)."""
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4) & 7, (code & 15).astype(np.int32)
    size = (((mantissa << 3) + 0x84) << exponent) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit value of each A-law code (G.711); all 256 values differ."""
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


ULAW, ALAW = ulaw_table(), alaw_table()
_ALAW_CODE = np.zeros(1 << 16, np.uint8)
_ALAW_CODE[ALAW.astype(np.uint16)] = np.arange(256, dtype=np.uint8)


def alaw_codes(pcm: np.ndarray) -> np.ndarray:
    """A-law codes of samples that came from A-law; the inverse of the table."""
    return _ALAW_CODE[pcm.astype(np.int16).view(np.uint16)]


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM mono blocks (one a row: predictor int16, index byte, reserved byte, nibbles) to samples.

    The loop runs over the samples of a block; every step handles all blocks.
    """
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for i in range(2 * (size - 4)):
        nibble = (blocks[:, 4 + i // 2] >> (4 * (i & 1))) & 15
        step, low = STEPS[index], (nibble & 7).astype(np.int32)
        delta = (step >> 3) + (step >> 2) * (low & 1) + (step >> 1) * ((low >> 1) & 1) + step * (low >> 2)
        value = np.clip(np.where(nibble & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + INDEX_STEP[low], 0, 88)
        out[:, 1 + i] = value
    return out


def upsample(pcm: np.ndarray, factor: int) -> np.ndarray:
    """``factor`` times as many samples; every ``factor``-th is an original, the rest are interpolated."""
    if factor == 1 or not len(pcm):
        return pcm.astype(np.int16)
    here = pcm.astype(np.int32)
    after = np.append(here[1:], here[-1:])
    out = np.empty((len(pcm), factor), np.int16)
    for i in range(factor):
        out[:, i] = here + (after - here) * i // factor
    return out.reshape(-1)


def wav(pcm: np.ndarray, rate: int) -> bytes:
    """16-bit mono PCM WAV file."""
    body = pcm.astype("<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body)) + body


def read_wav(stored: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAV file written by :func:`wav`; other chunks are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (kind, channels, bits) != (1, 1, 16):
                raise ValueError("not 16-bit mono PCM")
        elif name == b"data":
            return np.frombuffer(stored, "<i2", size // 2, at + 8), rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(payload: np.ndarray, encoding: str, block: int = 256) -> np.ndarray:
    """Samples of a payload: ``ulaw``, ``alaw`` or ``adpcm`` (in blocks of ``block`` bytes)."""
    if encoding == "ulaw":
        return ULAW[payload]
    if encoding == "alaw":
        return ALAW[payload]
    if encoding != "adpcm":
        raise ValueError(f"unknown encoding {encoding}")
    padded = np.zeros(-(-len(payload) // block) * block, np.uint8)
    padded[: len(payload)] = payload
    return decode_adpcm(padded.reshape(-1, block)).reshape(-1)


def to_pcm(calls: DataFrame, payload_col: str, encoding: str, factor: int = 2, rate: int = 8000, id_col: str = "doc_id", block: int = 256) -> DataFrame:
    """Rows ``(id, samples, wav)``: each payload decoded, resampled by ``factor`` and stored as WAV."""
    chosen = calls.select(F.col(id_col).alias("id"), F.col(payload_col).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "payload"):
            data, off = utf8(b.column("payload"))
            files = [wav(upsample(decode(data[i:j], encoding, block), factor), rate * factor) for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([(len(x) - 44) // 2 for x in files], pa.int64()), pa.array(files, pa.binary())], ["id", "samples", "wav"]
            )

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, samples long, wav binary")


UNIT = 64
RATE, FACTOR = 8000, 2


def _features(pcm: np.ndarray, off: np.ndarray) -> list[str]:
    """Level, peak and zero crossings of consecutive non-empty pieces of a signal."""
    x = pcm.astype(np.int64)
    at, n = off[:-1], np.diff(off)
    square, peak = np.add.reduceat(x * x, at), np.maximum.reduceat(np.abs(x), at)
    cross = np.zeros(len(x), np.int64)
    cross[1:] = (x[1:] < 0) != (x[:-1] < 0)
    cross[at] = 0
    crossings = np.add.reduceat(cross, at)
    return [f"{int(s // k)}/{int(p)}/{int(c)}" for s, k, p, c in zip(square, n, peak, crossings, strict=True)]


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's bytes as A-law telephony audio in resampled PCM, read it back, describe it.

    The payload (UTF-8, zero bytes up to a positive multiple of 64) is taken as
    A-law samples at 8 kHz, expanded by table, resampled to 16 kHz and stored as
    WAV.  Reading takes every second sample and inverts the table; all 256 A-law
    values differ, so the payload returns exactly.  ``feature`` has mean square,
    peak and zero crossings of the stored PCM, of the payload read as mu-law, and
    of the payload decoded as 64-byte ADPCM blocks.
    """
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text", 1 << 19):
            data, off = utf8(b.column("text"))
            n = np.diff(off)
            size = np.maximum(-(-n // UNIT), 1) * UNIT
            to = np.concatenate([[0], np.cumsum(size)])
            payload = np.zeros(to[-1], np.uint8)
            payload[np.arange(len(data)) + np.repeat(to[:-1] - off[:-1], n)] = data
            rows, back, stored = [], np.empty_like(payload), []
            for i, j in zip(to[:-1], to[1:], strict=True):
                media = wav(upsample(decode(payload[i:j], "alaw"), FACTOR), RATE * FACTOR)
                pcm, _ = read_wav(media)
                back[i:j] = alaw_codes(pcm[::FACTOR])
                own = back[i:j].tobytes()
                stored.append(pcm)
                rows.append((len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
            adpcm = decode_adpcm(back.reshape(-1, UNIT))
            told = zip(_features(np.concatenate(stored), to * FACTOR), _features(ULAW[back], to), _features(adpcm.reshape(-1), to // UNIT * adpcm.shape[1]), strict=True)
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(n, pa.int64()),
                    *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)),
                    pa.array([f"pcm={a};ulaw={u};adpcm={d}" for a, u, d in told], pa.string()),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(
        run,
        f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_telephony_audio": op1_telephony_audio}
ORACLES: dict[str, str] = {}
