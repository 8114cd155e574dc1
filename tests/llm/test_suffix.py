"""Removal of repeated strings against a dictionary of all 200-byte strings."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from platterlake.llm import suffix_dedup as sd
from platterlake.llm._shared import pack, unpack


def slow(rows, length=200):
    raw = [(r[1] or "").encode() for r in rows]
    n = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for r, x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if n[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def passages(seed, n=70):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    shared = [text(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40) * rng.randrange(2)
            parts += [s[a:], text(rng.choice([0, 1, 5, 250]))]
        out.append("".join(parts))
    common = text(160)  # shared by many, in different surroundings of which some agree
    out += [f"{text(3)}{'xyz'[i % 3] * 20}{common}{'uvw'[i % 2] * 25}{text(60)}" for i in range(60)]
    return out + [out[3], out[3], "z" * 199, "z" * 200, "z" * 1000, "ab" * 700, text(199)]


@pytest.mark.parametrize("places", [10**6, 7])
def test_remove_repeats(make_docs, odd_texts, places):
    rows = [(i, t, "en", "s") for i, t in enumerate([*passages(places), *[t for t in odd_texts if len(t or "") < 200_000 or t[0] == "x"][:8], *odd_texts[9:]])]
    rows = [(r[0], r[1][:3000] if r[1] and len(r[1]) > 100_000 else r[1], *r[2:]) for r in rows] + [(None, "null id", "en", "s"), (3, "again", "en", "s")]
    docs = make_docs(rows, 4).withColumn("chunk", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("data", F.lit(1))
    got = sd.remove_repeats(docs, texts=True, places=places, shard=9000).collect()
    assert sorted((tuple(map(str, r[:5])) for r in got)) == sorted(tuple(map(str, r[:5])) for r in slow(rows))
    kept = defaultdict(list)
    for r in slow(rows):
        kept[r[0]].append(r[5])
    assert all(bytes(r.kept) in kept[r.doc_id] for r in got)


def test_texts_of_many_tiles_are_searched_whole(make_docs):
    """A text of 3 MB, many tiles and more than a chunk, shares strings with itself far apart and with a short text."""
    rng = random.Random(5)
    letters = lambda k: bytes(rng.getrandbits(8) % 60 + 40 for _ in range(k)).decode()
    body, common, edge = letters(3 << 20), letters(900), letters(240)
    far = body[:100_000] + common + body[100_000:2_000_000] + "é" + common[50:800] + body[2_000_000:]
    rows = [(1, far, "en", "s"), (2, letters(40) + common[100:500] + letters(30), "en", "s"), (3, edge + body[1 << 18 : (1 << 18) + 199], "en", "s"), (4, edge, "en", "s")]
    got = sorted(tuple(r[:5]) for r in sd.remove_repeats(make_docs(rows)).collect())
    raw = {r[0]: r[1].encode() for r in rows}
    n = Counter(hash(x[i : i + 200]) for x in raw.values() for i in range(len(x) - 199))
    want = []
    for i, x in raw.items():
        gone = np.zeros(len(x) + 1, np.int64)
        for at in range(len(x) - 199):
            if n[hash(x[at : at + 200])] > 1:
                gone[at] += 1
                gone[at + 200] -= 1
        out = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(x, np.uint8)[~out].tobytes()
        want.append((i, len(x), int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == want and want[0][2] == 2 * 750


def test_nothing(make_docs):
    assert sd.remove_repeats(make_docs([])).count() == 0
    assert [tuple(r)[1:4] for r in sd.remove_repeats(make_docs([None, ""])).collect()] == [(0, 0, 0)] * 2


def test_tiles_do_not_matter(monkeypatch):
    data = np.frombuffer("".join(passages(2)).encode(), np.uint8)
    off = np.array([0, 150, 5000, 5000, len(data)])
    whole = sd.Segments(data, off)
    monkeypatch.setattr(sd, "TILE", 700)
    cut = sd.Segments(data, off)
    strings = lambda s: {(i + k, a) for i, n, a in zip(s.start.tolist(), s.count.tolist(), s.anchor.tolist(), strict=True) for k in range(n)}
    assert strings(whole) == strings(cut)
    assert {i for i, _ in strings(whole)} == {i for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for i in range(lo, hi - 199)}


def test_one_name_with_different_anchors_is_no_repeat(monkeypatch):
    class Clash(sd.Segments):
        def __init__(self, data, off):
            super().__init__(data, off)
            self.name[:] = 7

    monkeypatch.setattr(sd, "Segments", Clash)
    rng = np.random.default_rng(4)
    once, twice = rng.integers(0, 256, 1500, np.uint8), rng.integers(0, 256, 400, np.uint8)
    data = np.concatenate([once, twice, twice])
    off = np.array([0, 1500, 1900, 2300])
    body = pack(np.arange(3), np.zeros(3, bool), off, np.frombuffer(zstandard.ZstdCompressor(1).compress(data.tobytes()), np.uint8))
    asked = [(k, m) for k, m in sd.key_messages(sd.Segments(data, off), 3)]
    by = {k: sd.answer((pa.scalar(k),), pa.table({"chunk": [0], "shard": [k], "data": pa.array([m], pa.binary())})) for k, m in asked}
    out = sd.open_segments(pa.table({"chunk": [0], "data": pa.array([body], pa.binary())}), pa.concat_tables(by.values()), 3, 100)
    marks = next(r for r in out.to_pylist() if r["kind"] == "marks")
    starts, ends = unpack(marks["data"], "<u4", "<u4")
    assert len(starts) and starts.min() >= 1500  # only what is there twice
    assert {i for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for i in range(a, b)} == set(range(1500, 2300))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(260))
    texts = [base, base[5:250], b"a" * 230, bytes(rng.choice(b"ab") for _ in range(300)), base[:201], b"a" * 205]
    data = np.frombuffer(b"".join(texts), np.uint8)
    start = np.cumsum([0, *map(len, texts)])[:-1]
    count = np.array([len(t) - 199 for t in texts])
    array, label = sd.classes(data, start, count)
    strings = [data[i : i + 200].tobytes() for i in array]
    assert strings == sorted(strings) and len(strings) == count.sum()
    assert label.tolist() == [sorted(set(strings)).index(s) for s in strings]
    before = np.full(len(data), -1)
    before[array[1:]] = array[:-1]
    ends = np.repeat(start + count + 199, count + 199)
    common = sd.kasai(data, ends - np.arange(len(data)), before, start, count)
    for i, j in zip(array[1:], array[:-1], strict=True):
        a, b = data[i : ends[i]].tobytes(), data[j : ends[j]].tobytes()
        assert b <= a
        assert common[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
