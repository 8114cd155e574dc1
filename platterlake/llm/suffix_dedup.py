"""Removal of repeated 200-byte strings by suffix arrays in shards.

A byte goes if some 200-byte string that covers it starts at another place too, in
the same text or any other.  Every string is judged on the input.

1. Candidates.  A string's anchor is the 32-byte piece in it with the least hash
   (the leftmost of equals), so equal strings have equal anchors at equal places.
   Consecutive strings of one anchor form a segment.  Chunks of texts tell hash
   shards their anchors and segments; shards answer with the totals.  A string can
   only repeat if its anchor does.  Segments that are equal as a whole need one copy
   to represent them; those that differ but share an anchor are open.
2. Suffix arrays.  Open segments, and one copy of each repeated segment that shares
   an anchor with another, meet in a shard by anchor.  There the suffixes are ranked
   by Larsson-Sadakane refinement in numpy: by 7 bytes first, then doubling the depth,
   each round sorting only the groups that are still tied.  Kasai's
   algorithm, one lane a segment, gives the common prefix of neighbours; neighbours
   with 200 bytes in common are copies.
3. Merging.  An anchor with very many places is dealt to several shards.  Each sends
   its sorted list of different strings, the lists are merged by binary search, and a
   string found in two shards is a copy in both.
4. Chunks join the marks and drop the covered bytes.

Scale: a chunk is about CHUNK bytes of text and counts each key once, so a key costs
one entry a chunk however frequent it is.  Suffix arrays are built over BATCH bytes
at a time.  Texts are written once to the shared folder, compressed, and dealt by
chunk twice; everything else that is dealt is small against the input.  Segments and
anchors are known by 64-bit hashes and segments are counted by name and anchor
together, so a false repeat takes two equal 64-bit hashes, or one between different
segments around the same 32 bytes.

Defined results: a null or empty text, and any under 200 bytes, stays whole; rows
equal in id and text are separate texts, copies of each other; other columns are
ignored; an empty table gives an empty result.  Texts are never cut into pieces: a
string that crosses the border of any working unit is still judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, pack, table, text_blocks, unpack, utf8
from ._words import _VALUE, _powers, mix, per_row

LENGTH, PIECE = 200, 32
WIDE = LENGTH - PIECE + 1
#: Bytes of text in a chunk, of strings scanned at once, a counting shard, and a suffix array; places of an anchor in one shard.
CHUNK, TILE, SHARD, BATCH, PLACES = 3 << 19, 1 << 18, 48 << 20, 1 << 20, 3000
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive entries, from running minima forward and back in blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Segments:
    """Segments of a chunk: ``start``, ``count`` of strings, hash of the ``anchor`` and of the whole (``name``)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        parts: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64))]
        for at in range(0, max(len(data) - LENGTH + 1, 0), TILE):
            parts.append(self._tile(data[at : at + TILE + LENGTH - 1], off - at, at))
        self.start, self.count, self.anchor, self.name = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _tile(d: np.ndarray, off: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(d)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[d] * up[:n], out=total[1:])
        piece = (total[PIECE:] - total[:-PIECE]) * down[: n - PIECE + 1]
        order = (piece ^ (piece >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        owner = (sliding_least((order & _HIGH) | np.arange(len(order), dtype=np.uint64), WIDE) & _LOW).astype(np.int64)
        # Strings that would cross the end of a row are none.
        ends = off[1:-1]
        ends = ends[(ends > 0) & (ends < n)]
        m = len(owner)
        step = np.bincount(np.clip(ends - LENGTH + 1, 0, m), minlength=m + 1) - np.bincount(np.minimum(ends, m), minlength=m + 1)
        good = np.cumsum(step)[:m] == 0
        edge = np.ones(m + 1, bool)
        edge[1:-1] = (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])
        cut = np.flatnonzero(edge)
        lo, hi = cut[:-1], cut[1:]
        lo, hi = lo[good[lo]], hi[good[lo]]
        own = owner[lo]
        end = hi + LENGTH - 1
        name = mix((total[end] - total[lo]) * down[lo] + (end - lo).astype(np.uint64) * np.uint64(1 << 20) + (own - lo).astype(np.uint64))
        return lo + at, hi - lo, mix(piece[own]), name


# --- Suffix arrays


def suffix_ranks(text: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane ranks of all suffixes; ``reach[i]`` is the length of suffix i, which ends with its segment.

    A suffix comes before those that go on after it.  A rank is the number of places
    before its group; only equal suffixes of equal length stay in one group.
    """
    n = len(text)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    short = np.minimum(reach, 7).astype(np.uint64)
    first = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    drop = (np.uint64(8) - short) * np.uint64(8)  # the bytes after the end, and the eighth
    first = (first >> drop << drop) | short
    order = np.argsort(first)
    s = first[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = order[~(new & np.append(new[1:], True))]
    depth = 7
    while True:
        active = active[reach[active] >= depth]  # the rest are whole and equal
        if not len(active):
            return rank
        after = np.where(reach[active] > depth, rank[np.minimum(active + depth, n - 1)] + 1, 0)
        pair = rank[active] * np.int64(n + 1) + after
        order = np.argsort(pair)
        active, s = active[order], pair[order]
        old = rank[active]
        new, group = np.ones(len(s), bool), np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        group[1:] = old[1:] != old[:-1]
        here = np.arange(len(s))
        rank[active] = old + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
        active = active[~(new & np.append(new[1:], True))]
        depth *= 2


def kasai(text: np.ndarray, reach: np.ndarray, before: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Common prefix of every listed suffix with the one before it in the suffix array.

    ``before[i]`` is that neighbour of place i, or -1.  Kasai's rule: the common prefix
    shrinks by one at most from a place to the next, if the neighbour's next place is in
    the suffix array too.  All segments advance together.
    """
    out = np.zeros(len(text), np.int64)
    lanes = np.argsort(-count, kind="stable")
    size = count[lanes]
    h, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), -1)
    listed = np.zeros(len(text) + 1, bool)
    listed[np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)] = True
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))  # lanes with a place at this step come first
        i = start[lanes[:live]] + step
        j = before[i]
        own = np.where((j >= 0) & (last[:live] >= 0) & listed[last[:live] + 1], np.maximum(h[:live] - 1, 0), 0)
        most = np.where(j >= 0, np.minimum(reach[i], reach[j]), 0)
        own = np.minimum(own, most)
        go = np.flatnonzero(own < most)
        while len(go):
            same = text[i[go] + own[go]] == text[j[go] + own[go]]
            go = go[same]
            own[go] += 1
            go = go[own[go] < most[go]]
        h[:live], last[:live] = own, j
        out[i] = own
    return out


def classes(text: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings in the order of the suffix array, and the number of each one's class of equal strings.

    Segments follow each other; segment k has ``count[k]`` strings from ``start[k]`` on,
    and its text goes on for LENGTH - 1 bytes after the last begins.
    """
    size = count + LENGTH - 1
    reach = np.repeat(start + size, size) - np.arange(len(text))
    rank = suffix_ranks(text, reach)
    strings = np.flatnonzero(reach >= LENGTH)
    array = strings[np.argsort(rank[strings], kind="stable")]
    before = np.full(len(text), -1)
    before[array[1:]] = array[:-1]
    common = kasai(text, reach, before, start, count)
    return array, np.cumsum(common[array] < LENGTH) - 1


# --- Stages


def bodies(docs: DataFrame, shards: int) -> DataFrame:
    """Rows (kind, chunk, shard, data): the chunk's texts, and its anchors and segments for each counting shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(1)
        number = TaskContext.get().partitionId() << 32
        for b in text_blocks(batches, "text", CHUNK):
            data, off = utf8(b.column("text"))
            ids = b.column("doc_id")
            body = pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), off, np.frombuffer(squeeze.compress(data.tobytes()), np.uint8))
            out = [("body", number, -1, body)]
            out += [("keys", number, s, keys) for s, keys in key_messages(Segments(data, off), shards)]
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["kind", "chunk", "shard", "data"])

    return rows.mapInArrow(run, "kind string, chunk bigint, shard int, data binary")


def distinct(name: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each different (name, anchor), in that order, and the number of each one's pair."""
    order = np.lexsort((anchor, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (anchor[order][1:] != anchor[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def key_messages(s: Segments, shards: int) -> Iterator[tuple[int, bytes]]:
    """For each counting shard, the chunk's anchors and segments with their counts; a segment is known by name and anchor."""
    anchors, an = np.unique(s.anchor, return_counts=True)
    first, of = distinct(s.name, s.anchor)
    names, beside, nn = s.name[first], s.anchor[first], np.bincount(of, minlength=len(first))
    ca, cn = shard_cuts(anchors, shards), shard_cuts(names, shards)
    for k in range(shards):
        a, n = slice(ca[k], ca[k + 1]), slice(cn[k], cn[k + 1])
        if a.start < a.stop or n.start < n.stop:
            yield k, pack(anchors[a], an[a].astype("<u4"), names[n], beside[n], nn[n].astype("<u4"))


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where ascending hashes cross from one shard's range to the next."""
    return np.searchsorted(keys, np.array([(i << 64) // shards for i in range(shards)] + [(1 << 64) - 1], np.uint64))


def read_body(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, null, off, squeezed = unpack(data, "<i8", "?", "<i8", "u1")
    return pa.array(ids, mask=null), np.frombuffer(zstandard.ZstdDecompressor().decompress(squeezed.tobytes()), np.uint8), off


def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """For each chunk: totals of its anchors and segments, and whether it is the first to have a segment."""
    group = group.sort_by("chunk")
    parts = [unpack(x, "<u8", "<u4", "<u8", "<u8", "<u4") for x in group.column("data").to_pylist()]
    anchors, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(anchors))
    first, of = distinct(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))
    whole = np.bincount(of, np.concatenate([p[4] for p in parts]), len(first))
    least = np.zeros(len(of), bool)
    least[first] = True
    data, i, j = [], 0, 0
    for p in parts:
        a, n = at[i : i + len(p[0])], of[j : j + len(p[2])]
        data.append(pack(total[a].astype("<u4"), whole[n].astype("<u4"), least[j : j + len(p[2])]))
        i, j = i + len(a), j + len(n)
    return pa.table({"chunk": group.column("chunk"), "shard": group.column("shard"), "data": pa.array(data, pa.binary())})


KINDS = "kind string, chunk bigint, shard int, data binary"


def _out(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "chunk", "shard", "data"), cols, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges (from, to) that strings at the given places cover, joined where the places follow each other."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.diff(starts, prepend=starts[0] - 2) > 1)
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] + LENGTH


def open_segments(body: pa.Table, answers: pa.Table, shards: int, places: int) -> pa.Table:
    """Of a chunk: the ranges that repeat as whole segments, and what each suffix-array shard must look at."""
    if not body.num_rows:
        return _out([])
    chunk = body.column("chunk")[0].as_py()
    _, data, off = read_body(body.column("data")[0].as_py())
    s = Segments(data, off)
    if not len(s.start):
        return _out([])
    anchors = np.unique(s.anchor)
    first, of_name = distinct(s.name, s.anchor)
    got = [unpack(x, "<u4", "<u4", "?") for x in answers.sort_by("shard").column("data").to_pylist()]
    total, whole, least = (np.concatenate([g[i] for g in got]) for i in range(3))
    assert len(total) == len(anchors) and len(whole) == len(first)
    of_anchor = total[np.searchsorted(anchors, s.anchor)].astype(np.int64)
    of_whole = whole[of_name].astype(np.int64)
    repeats = of_whole > 1
    once = np.zeros(len(s.start), bool)
    once[first] = True
    send = np.flatnonzero((~repeats & (of_anchor > 1)) | (repeats & once & least[of_name] & (of_anchor > of_whole)))
    covered = pack(s.start[repeats].astype("<u4"), (s.start[repeats] + s.count[repeats] + LENGTH - 1).astype("<u4"))
    out = [("marks", chunk, -1, covered)]
    parts = -(-of_anchor[send] // places)
    salt = (s.name[send] >> np.uint64(17)) % parts.astype(np.uint64)
    shard = (mix(s.anchor[send] + mix(salt)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    send, shard, parts = send[order], shard[order], parts[order]
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        i = send[cut[k] : cut[k + 1]]
        size = s.count[i] + LENGTH - 1
        text = data[np.arange(int(size.sum())) + np.repeat(s.start[i] - (np.cumsum(size) - size), size)]
        out.append(("open", chunk, k, pack(s.anchor[i], s.start[i].astype("<u4"), s.count[i].astype("<u2"), repeats[i], parts[cut[k] : cut[k + 1]] > 1, text)))
    return _out(out)


def search_shard(group: pa.Table, shards: int) -> pa.Table:
    """Suffix arrays over a shard's segments: marks for chunks, and strings of anchors that have other shards too."""
    chunks = group.column("chunk").to_numpy()
    parts = [unpack(x.as_py(), "<u8", "<u4", "<u2", "?", "?", "u1") for x in group.column("data")]
    sizes = [len(p[0]) for p in parts]
    chunk = np.repeat(chunks, sizes)
    anchor, start, count, known, wide, text = (np.concatenate([p[i] for p in parts]) for i in range(6))
    del parts
    start, count = start.astype(np.int64), count.astype(np.int64)
    size = count + LENGTH - 1
    at = np.cumsum(size) - size
    order = np.argsort(anchor, kind="stable")
    # Whole anchors are put together until a batch is full.
    ends = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
    filled = np.concatenate([[0], np.cumsum(size[order])])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sent: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo < len(order):
        hi = int(ends[max(np.searchsorted(filled[ends], filled[lo] + BATCH, "right") - 1, np.searchsorted(ends, lo, "right"))])
        own = order[lo:hi]
        lo = hi
        n = size[own]
        first = np.cumsum(n) - n
        local = text[np.arange(int(n.sum())) + np.repeat(at[own] - first, n)]
        array, label = classes(local, first, count[own])
        segment = np.searchsorted(first, array, "right") - 1
        many = np.bincount(label)[label] > 1
        original = own[segment]
        place = start[original] + array - first[segment]
        mark = many & ~known[original]
        found.append((chunk[original[mark]], place[mark]))
        if wide[own].any():
            head = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]) & wide[original])
            alone = ~many[head] & ~known[original[head]]
            # The name of a string: of its bytes, and of its anchor.
            up, down = _powers(len(local) + 1)
            total = np.zeros(len(local) + 1, np.uint64)
            np.cumsum(_VALUE[local] * up[: len(local)], out=total[1:])
            i = array[head]
            name = mix((total[i + LENGTH] - total[i]) * down[i]) ^ anchor[original[head]]
            sent.append((name, np.where(alone, chunk[original[head]], -1), np.where(alone, place[head], 0)))
    out = []
    c, p = (np.concatenate([f[i] for f in found]) for i in range(2))
    for k in np.unique(c).tolist():
        a, b = _ranges(p[c == k])
        out.append(("marks", k, -1, pack(a.astype("<u4"), b.astype("<u4"))))
    if sent:
        name, c, p = (np.concatenate([x[i] for x in sent]) for i in range(3))
        order = np.argsort(name)
        name, c, p = name[order], c[order], p[order]
        cut = shard_cuts(name, shards)
        for k in range(shards):
            i = slice(cut[k], cut[k + 1])
            if i.start < i.stop:
                out.append(("list", -1, k, pack(name[i], c[i].astype("<i8"), p[i].astype("<u4"))))
    return _out(out)


def merge_lists(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Sorted lists of different strings, one a shard: those in two lists are marked where they stand alone."""
    lists = [unpack(x, "<u8", "<i8", "<u4") for x in group.column("data").to_pylist()]
    every = np.sort(np.concatenate([x[0] for x in lists]))
    chunk, place = [], []
    for name, c, p in lists:
        twice = np.searchsorted(every, name, "right") - np.searchsorted(every, name, "left") > 1
        chunk.append(c[twice & (c >= 0)])
        place.append(p[twice & (c >= 0)])
    c, p = np.concatenate(chunk), np.concatenate(place).astype(np.int64)
    out = []
    for k in np.unique(c).tolist():
        a, b = _ranges(p[c == k])
        out.append(("marks", k, -1, pack(a.astype("<u4"), b.astype("<u4"))))
    return _out(out)


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def drop_bytes(body: pa.Table, marks: pa.Table, texts: bool) -> pa.Table:
    """Result rows of a chunk."""
    names = [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * texts
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
    if not body.num_rows:
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
    ids, data, off = read_body(body.column("data")[0].as_py())
    ranges = [unpack(x, "<u4", "<u4") for x in marks.column("data").to_pylist()]
    begin, end = (np.concatenate([r[i] for r in ranges] or [np.empty(0, np.uint32)]) for i in range(2))
    n = len(data) + 1
    gone = np.cumsum(np.bincount(begin, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    edge = off[:-1][off[:-1] < len(data)]
    opens[edge] = gone[edge]
    left, kept = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[off]
    pieces = [left[i:j].tobytes() for i, j in zip(kept[:-1], kept[1:], strict=True)]
    cols = [ids, np.diff(off), per_row(gone, off), per_row(opens, off), [hashlib.sha256(x).hexdigest() for x in pieces], *([pieces] * texts)]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, places: int | None = None, shard: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, places = max(1, -(-size // (shard or SHARD))), places or PLACES
    parts = materialize(bodies(docs, shards), "suffix-bodies", "kind")
    body = parts.where("kind = 'body'").select("chunk", "data")
    answers = materialize(parts.where("kind = 'keys'").select("chunk", "shard", "data").groupBy("shard").applyInArrow(answer, "chunk bigint, shard int, data binary"), "suffix-answers")
    ask: Callable = lambda b, a: open_segments(b, a, shards, places)
    opened = materialize(body.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, KINDS), "suffix-open", "kind")
    found = opened.where("kind = 'open'").select("chunk", "shard", "data").groupBy("shard").applyInArrow(lambda t: search_shard(t, shards), KINDS)
    found = materialize(found, "suffix-found", "kind")
    merged = found.where("kind = 'list'").select("shard", "data").groupBy("shard").applyInArrow(merge_lists, KINDS)
    marks = opened.where("kind = 'marks'").select("chunk", "data").union(found.where("kind = 'marks'").select("chunk", "data")).union(merged.select("chunk", "data"))
    final: Callable = lambda b, m: drop_bytes(b, m, texts)
    return body.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(final, RESULT + ", kept binary" * texts)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
