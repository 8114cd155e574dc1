"""Byte-level BPE encoding by longest matches with backtracking, and decoding.

Vocabulary tokens are mapped to Latin-1 strings, so that pyahocorasick finds every
token that starts at each byte of a piece.  The encoder walks the piece with the
longest match at each place.  A token may follow another only if BPE would leave
the two apart; that test undoes merges on both sides of the border, and its answers
are memoised.  If no token fits, the encoder takes the last one back and tries the
next shorter prefix there; a place that failed once is never entered again, so the
work is linear in the piece.  The result equals merging pairs by rank.

That equality needs every longer token to be made of two tokens of lower rank, as
in any trained vocabulary; :func:`splits` finds out.  For other vocabularies the
encoder merges pairs by rank plainly.

Defined results: a null or empty text has no tokens; repeated rows get equal
results; other columns are ignored; an empty table gives an empty result; texts
are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_blocks, utf8

#: Pieces in each of two generations of the cache, memoised token pairs, and the longest piece kept.
PIECES, PAIRS, LONGEST = 250_000, 500_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain BPE: join the adjacent pair of lowest rank (under ``below``), leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def splits(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For every token that merging lower ranks makes: the two tokens it is made of (itself twice for a byte)."""
    out = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            out[rank] = (rank, rank)
        elif len(parts := merge(token, ranks, rank)) == 2:
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Encoder:
    """Encodes pieces of bytes by the ranks; ``made`` is the result of :func:`splits`."""

    def __init__(self, ranks: dict[bytes, int], made: dict[int, tuple[int, int]] | None = None):
        made = splits(ranks) if made is None else made
        self.whole = ranks
        self.sound = len(made) == len(ranks)
        self.text = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.text[rank] = token
        self.left = {t: a for t, (a, _) in made.items()}
        self.right = {t: b for t, (_, b) in made.items()}
        self.joined = {p: t for t, p in made.items() if len(self.text[t]) > 1}
        self.size = list(map(len, self.text))
        self.shorter = {}
        self.machine = ahocorasick.Automaton()
        for t in made:
            token = self.text[t]
            self.machine.add_word(token.decode("latin-1"), t)
            self.shorter[t] = next((r for k in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:k])) in made), None)
        self.machine.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}

    def _apart(self, one: int, two: int) -> bool:
        """Whether BPE leaves the two tokens side by side."""
        limit = 1 << 62
        while True:
            both = self.joined.get((one, two))
            if both is not None and both < limit:
                return False
            if one > two:
                limit, one = one, self.right[one]
                if one == limit:
                    limit, two = two + 1, self.left[two]
                    if two + 1 == limit:
                        return True
            else:
                limit, two = two + 1, self.left[two]
                if two + 1 == limit:
                    limit, one = one, self.right[one]
                    if one == limit:
                        return True

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        if (whole := self.whole.get(piece)) is not None:
            return [whole]
        if not self.sound:
            return [self.whole[x] for x in merge(piece, self.whole)]
        size, shorter, apart = self.size, self.shorter, self.apart
        longest = [None] * (len(piece) + 1)
        for end, t in self.machine.iter(piece.decode("latin-1")):
            longest[end + 1 - size[t]] = t  # matches come by their end, so the longest comes last
        closed = bytearray(len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + size[token]
            fits = not closed[end]
            if fits and out:
                pair = (out[-1], token)
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) >= PAIRS:
                        apart.clear()
                    fits = apart[pair] = self._apart(*pair)
            if fits:
                out.append(token)
                at, token = end, longest[end]
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
        return out


@cache
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Codec:
    """Texts to ids and back: splits by a pattern and encodes each match separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, made: dict[int, tuple[int, int]] | None = None):
        self.encoder, self.find = Encoder(ranks, made), _pattern(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was known before; what is used again moves back

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.old.get(piece)
                if ids is None:
                    ids = pack(f"<{len(got := self.encoder.encode(piece.encode()))}I", *got)
                if len(piece) <= LONGEST:
                    if len(known) >= PIECES:
                        self.old, self.known = known, (known := {})
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.encoder.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(key: str, ranks: dict[bytes, int], pattern: str, made: dict[int, tuple[int, int]]) -> Codec:
    """One codec a worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern, made)
    return _CODECS[key]


def encode_column(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    The vocabulary is read once on the driver and broadcast: its size is that of
    the file, whatever the corpus.
    """
    spark = docs.sparkSession
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((key, ranks, pattern, splits(ranks)))
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for b in text_blocks(batches, "text", 1 << 20):
            data, off = utf8(b.column("text"))
            raw = data.tobytes()
            n, blobs, one, two = [], [], [], []
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                got = own.encode(raw[i:j].decode("utf-8", "replace"))
                n.append(len(got) // 4)
                one.append(hashlib.sha256(got).hexdigest())
                two.append(hashlib.sha256(own.decode(got)).hexdigest())
                if ids:
                    blobs.append(np.frombuffer(got, "<u4").astype(np.int32))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols, names = [*cols, pa.array(blobs, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    id_type = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_column(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
