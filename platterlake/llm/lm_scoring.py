"""Language-model scoring by an Elias-Fano bigram trie in shards.

Tokens are lower-cased words and one end token a text, which is also the context of
the next text's first word.  Unigrams are discounted absolutely and an unseen word
has the discounts' mass, P1(w) = (c(w) - D) / N or D * V / N.  Bigrams back off by
P(w | v) = (c(v w) + m(v) * P1(w)) / (c(v) + m(v)), with m(v) = RARE + SHARE * c(v)
for every context, whatever its count and the size of the input.  (Without
``every_context`` only contexts in the table of frequent words get more than RARE.)
Both sum to one.

Every token but the end is once a successor and once a context in its text, and the
end closes the ring, so the sum of log P over a text is the sum over its tokens of
log(c(v w) + m(v) * P1(w)) - log(c(w) + m(w)).  All that a term needs belongs to its
word w, apart from c(v).  So tokens are dealt to shards by w, and the counts of the
contexts that a shard meets and the table of frequent words lacks are sent to it; a shard counts the
training bigrams of its words, builds their trie (contexts, monotone pointers,
successors, 16-bit smoothed values) in memory-mapped files, and answers its tokens
by searching among the context's successors.  Each (chunk, shard) returns one
message of sums by document.

Passes over the texts: (a) count words, and find pairs that may be frequent; (b)
count those pairs exactly; (c) ask for the counts of contexts; (d) deal the tokens.

Scale: a shard is about SHARD bytes of text whatever the corpus.  Words over a
quarter of a shard are dealt by word and context instead, with their counts from
the table of frequent words; pairs of which one could fill a shard are scored where
they are met.  Both tables have a fixed size (FREQUENT words; pairs of a share of
1 / PAIRS in some task's text, PAIRS at most in all that are used).  Files of a trie
live while its task runs.

Defined results: a null or empty text is the end token alone; repeated rows get
equal scores; a null id is in training; other columns are ignored; an empty table
gives an empty result; without training texts every score is that of an unseen
token.  Texts are scored whole.  Rows of a partition must come in the same order if
a task runs again, as they do from files.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, pack, table, text_blocks, unpack, utf8
from ._words import Words, mix
from .elias_fano import Trie

#: Discount of unigrams, and the two parameters of m(v).
DISCOUNT, RARE, SHARE = 0.6, 4.0, 0.8
#: Bytes of text a shard and a chunk; entries of the two tables.
SHARD, CHUNK, FREQUENT, PAIRS = 9 << 20, 3 << 20, 1 << 17, 1 << 14
#: Pairs that are looked up at once.
STEP = 1 << 18
END = np.uint64(0xE17D0C5A11B2F3C5)
UNIVERSE = 1 << 48  # contexts in a shard are told apart by 48 bits of their hash
ANSWER = -1  # in the place of a chunk: counts of contexts


@dataclass
class Chunk:
    """Tokens of some rows: hash of word and of context, row, and per row id, held_out and number of tokens."""

    word: np.ndarray
    context: np.ndarray
    row: np.ndarray
    ids: pa.Array
    held: np.ndarray
    tokens: np.ndarray

    @property
    def train(self) -> np.ndarray:
        return ~self.held[self.row]


def read_chunk(b: pa.RecordBatch) -> Chunk:
    w = Words(*utf8(b.column("text")), lower=True)
    n = w.count + 1
    end = np.cumsum(n) - 1
    word = np.empty(int(n.sum()), np.uint64)
    word[end] = END
    inner = np.ones(len(word), bool)
    inner[end] = False
    word[inner] = w.hashes()
    context = np.empty_like(word)
    context[1:] = word[:-1]
    if len(word):
        context[0] = END  # as for every row: the token before its first is an end
    return Chunk(word, context, np.repeat(np.arange(len(n)), n), b.column("doc_id"), b.column("held_out").to_numpy(zero_copy_only=False), n)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(word + mix(context))


@dataclass
class Counts:
    """What all tasks share: N, V, the frequent words and pairs with their counts (hashes ascending)."""

    total: int
    distinct: int
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    every: bool = False

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def count(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of frequent words (0 for others), and whether a word is frequent."""
        at, hit = self._find(self.words, words)
        return np.where(hit, self.word_counts[at] if len(self.words) else 0, 0), hit

    def pair_count(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, hit = self._find(self.pairs, h)
        return np.where(hit, self.pair_counts[at] if len(self.pairs) else 0, 0), hit

    def weight(self, frequent: np.ndarray, count: np.ndarray) -> np.ndarray:
        """m(v), of contexts that are frequent or, with ``every``, of all by their exact counts."""
        return np.where(frequent | self.every, RARE + SHARE * count, RARE)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P1."""
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, count - DISCOUNT, DISCOUNT * self.distinct) / self.total


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, counts, len(u)).astype(np.int64)


def word_shard(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard that counts a word."""
    return (key >> np.uint64(32)).astype(np.int64) % shards


def by_shard(shard: np.ndarray, shards: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The arrays' entries of each shard that has some, as messages."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        yield s, pack(*(a[order[cut[s] : cut[s + 1]]] for a in arrays))


def count_words(rows: DataFrame, shards: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """N, V, the most frequent training words with their counts, pairs that may be frequent, and (owner, data) with all words' counts by shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, pairs, tokens = np.empty(0, np.uint64), np.empty(0, np.int64), (np.empty(0, np.uint64), np.empty(0, np.int64)), 0

        def out(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            some = list(by_shard(word_shard(key, shards), shards, key, n))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["shard", "data"])

        for b in text_blocks(batches, "text"):
            c = read_chunk(b)
            train = c.train
            key, n = add_up(np.concatenate([key, c.word[train]]), np.concatenate([n, np.ones(int(train.sum()), np.int64)]))
            if len(key) > 1_000_000:
                yield out(key, n)
                key, n = key[:0], n[:0]
            h, k = np.unique(pair_hash(c.context, c.word)[train], return_counts=True)
            tokens += int(train.sum())
            # Misra-Gries in blocks: a pair is let go only if its share so far is under 1 / PAIRS.
            much = k * (2 * PAIRS) >= max(int(train.sum()), 1)
            pairs = add_up(np.concatenate([pairs[0], h[much]]), np.concatenate([pairs[1], k[much]]))
            stays = pairs[1] * (2 * PAIRS) >= tokens
            pairs = pairs[0][stays], pairs[1][stays]
        if len(key):
            yield out(key, n)
        if len(pairs[0]):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId()], pa.int32()), pa.array([pack(*pairs)], pa.binary())], ["shard", "data"])

    def total(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [unpack(x, "<u8", "<i8") for x in group.column("data").to_pylist()]
        u, n = add_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        pair = key[0].as_py() < 0
        sums = (0, 0) if pair else (int(n.sum()), len(u))
        whole = None if pair else pack(u, n)
        if not pair:  # more are not needed from one shard for the table
            most = np.argsort(-n, kind="stable")[:FREQUENT]
            u, n = u[most], n[most]
        return pa.table({"pair": [pair], "total": pa.array([sums[0]], pa.int64()), "distinct": pa.array([sums[1]], pa.int64()), "h": [u.view(np.int64)], "n": [n], "owner": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([whole], pa.binary())})

    each = rows.mapInArrow(deal, "shard int, data binary").groupBy("shard").applyInArrow(total, "pair boolean, total bigint, distinct bigint, h array<bigint>, n array<bigint>, owner int, data binary")
    each = materialize(each, "lm-words")
    sums = each.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    flat = each.select("pair", F.explode(F.arrays_zip("h", "n")).alias("e")).select("pair", "e.*")
    best = flat.where(~F.col("pair")).orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    maybe = flat.where("pair").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(PAIRS).toArrow()
    h, n = best.column("h").to_numpy().view(np.uint64), best.column("n").to_numpy()
    order = np.argsort(h)
    return sums.n or 0, sums.v or 0, h[order], n[order], np.sort(maybe.column("h").to_numpy().view(np.uint64)), each.where(~F.col("pair")).select("owner", "data")


def count_pairs(rows: DataFrame, pairs: np.ndarray) -> np.ndarray:
    """Exact training counts of the given pair hashes (ascending)."""
    if not len(pairs):
        return np.empty(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        n = np.zeros(len(keys), np.int64)
        for b in text_blocks(batches, "text"):
            c = read_chunk(b)
            at, hit = Counts._find(keys, pair_hash(c.context, c.word))
            n += np.bincount(at[hit & c.train], minlength=len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some])], ["i", "n"])

    out = np.zeros(len(pairs), np.int64)
    got = rows.mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def _sums(n: int, at: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.bincount(at, score, n), np.bincount(at, base, n), np.bincount(at[known], minlength=n)


def left_tokens(c: Chunk, counts: Counts, shards: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: which tokens are scored where they are met, and of the rest the places and the shards."""
    pair, hot = counts.pair_count(pair_hash(c.context, c.word))
    word_count, frequent = counts.count(c.word)
    hot &= frequent  # true of every frequent pair
    at = np.flatnonzero(hot)
    of_context, known_context = counts.count(c.context[at])
    if counts.every:  # a context outside the table is only known in the shards
        hot[at[~known_context]] = False
        at, of_context, known_context = at[known_context], of_context[known_context], known_context[known_context]
    left = np.flatnonzero(~hot)
    word, context = c.word[left], c.context[left]
    spread = word_count[left] * (4 * shards) >= max(counts.total, 1)
    shard = (np.where(spread, mix(word ^ mix(context)), word) >> np.uint64(20)) % np.uint64(shards)
    return pair, word_count, frequent, at, of_context, known_context, left, shard


def ask_contexts(batches: Iterator[pa.RecordBatch], counts: Counts, shards: int) -> Iterator[pa.RecordBatch]:
    """Messages (owner, data) to the shards that count words: contexts outside the table, and the shards that meet them."""
    word, shard = np.empty(0, np.uint64), np.empty(0, np.int32)

    def once(word: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((shard, word))
        word, shard = word[order], shard[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (shard[1:] != shard[:-1])
        return word[new], shard[new]

    def out(word: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
        some = list(by_shard(word_shard(word, shards), shards, word, shard))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["owner", "data"])

    for b in text_blocks(batches, "text"):
        c = read_chunk(b)
        *_, left, to = left_tokens(c, counts, shards)
        rare = np.flatnonzero(~counts.count(c.context[left])[1])
        word, shard = once(np.concatenate([word, c.context[left[rare]]]), np.concatenate([shard, to[rare].astype(np.int32)]))
        if len(word) > 1_000_000:
            yield out(word, shard)
            word, shard = word[:0], shard[:0]
    if len(word):
        yield out(word, shard)


def answer_contexts(key: tuple[pa.Scalar, ...], words: pa.Table, asked: pa.Table, shards: int) -> pa.Table:
    """A word shard's answer: for each shard that asks, its contexts and their exact counts."""
    known = [unpack(x, "<u8", "<i8") for x in words.column("data").to_pylist()]
    keys, n = known[0] if known else (np.empty(0, np.uint64), np.empty(0, np.int64))
    parts = [unpack(x, "<u8", "<i4") for x in asked.column("data").to_pylist()]
    word, shard = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, k) for i, k in enumerate((np.uint64, np.int32)))
    at, hit = Counts._find(keys, word)
    count = np.zeros(len(word), np.int64)
    count[hit] = n[at[hit]]
    some = list(by_shard(shard, shards, word >> np.uint64(16), count))
    size = len(some)
    return pa.table({"shard": pa.array([s for s, _ in some], pa.int32()), "chunk": pa.array([ANSWER] * size, pa.int64()), "head": pa.array([False] * size, pa.bool_()), "data": pa.array([x for _, x in some], pa.binary())})


def deal_tokens(batches: Iterator[pa.RecordBatch], counts: Counts, shards: int) -> Iterator[pa.RecordBatch]:
    """Messages (shard, chunk, head, data): tokens for each shard, and a head for the chunk itself."""
    number = TaskContext.get().partitionId() << 32
    for b in text_blocks(batches, "text", CHUNK):
        for start in range(0, b.num_rows, 1 << 16):
            c = read_chunk(b.slice(start, 1 << 16))
            rows = len(c.tokens)
            pair, word_count, frequent, at, of_context, known_context, left, shard = left_tokens(c, counts, shards)
            top = pair[at] + counts.weight(known_context, of_context) * counts.unigram(word_count[at])
            score = np.log10(top) - np.log10(word_count[at] + counts.weight(frequent[at], word_count[at]))
            sums = _sums(rows, c.row[at], score, np.log10(word_count[at] + 1.0), word_count[at] > 0)
            word, context, row = c.word[left], c.context[left], c.row[left].astype(np.uint16)
            order = np.lexsort((word, shard))
            word, context, row, shard = word[order], context[order], row[order], shard[order]
            cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
            held = np.packbits(c.held)
            messages = []
            for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                w, v = word[cut[s] : cut[s + 1]], context[cut[s] : cut[s + 1]] >> np.uint64(16)
                new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                messages.append(pack(w[new], np.diff(np.append(new, len(w))).astype("<u4"), (v >> np.uint64(16)).astype("<u4"), v.astype("<u2"), row[cut[s] : cut[s + 1]], held))
            some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            ids = c.ids.cast(pa.int64())
            head = pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), c.held, c.tokens.astype("<i8"), *sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*some, number % shards], pa.int32()),
                    pa.array([number] * (len(some) + 1), pa.int64()),
                    pa.array([False] * len(some) + [True]),
                    pa.array([*messages, head], pa.binary()),
                ],
                ["shard", "chunk", "head", "data"],
            )
            number += 1


def score_shard(group: pa.Table, counts: Counts) -> pa.Table:
    """Builds the shard's trie from its training tokens and returns sums by chunk and row."""
    answers = pc.equal(group.column("chunk"), ANSWER)
    told = [unpack(x, "<u8", "<i8") for x in group.filter(answers).column("data").to_pylist()]
    group = group.filter(pc.invert(answers))
    head = group.column("head").to_numpy()
    chunks = group.column("chunk").to_numpy()
    asked = group.filter(pa.array(~head)).column("data")
    parts = [unpack(x.as_py(), "<u8", "<u4", "<u4", "<u2", "<u2", "u1") for x in asked]
    sizes = np.array([len(p[4]) for p in parts], np.int64)
    out_data = []
    if parts:
        words, of_list = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        w = np.repeat(of_list.astype(np.int32), np.concatenate([p[1] for p in parts]))
        contexts, v = np.unique((np.concatenate([p[2] for p in parts]).astype(np.uint64) << np.uint64(16)) | np.concatenate([p[3] for p in parts]), return_inverse=True)
        row = np.concatenate([p[4] for p in parts])
        train = np.concatenate([~np.unpackbits(p[5]).astype(bool)[p[4]] for p in parts])
        del parts, of_list
        v *= len(words)
        v += w
        pairs, of_pair = np.unique(v, return_inverse=True)
        del v
        of_pair = of_pair.astype(np.int32)
        seen = np.bincount(of_pair[train], minlength=len(pairs))
        own, frequent = counts.count(words)
        in_shard = np.bincount(w[train], minlength=len(words))
        count = np.where(frequent, own, in_shard)
        below = counts.unigram(count)
        # Frequent words by the 48 bits that contexts have.
        order = np.argsort(counts.words >> np.uint64(16))
        short = Counts(0, 0, (counts.words >> np.uint64(16))[order], counts.word_counts[order], counts.pairs[:0], counts.pair_counts[:0])
        of_context, known_context = short.count(contexts)
        if counts.every:
            if told:
                keys, first = np.unique(np.concatenate([t[0] for t in told]), return_index=True)
                rest = Counts(0, 0, keys, np.concatenate([t[1] for t in told])[first], counts.pairs[:0], counts.pair_counts[:0])
                of_rest, known_rest = rest.count(contexts)
                of_context, known_context = np.where(known_context, of_context, of_rest), known_context | known_rest
            if not known_context.all():
                raise RuntimeError("a context's count is missing: the texts differ between two passes")
        weight = counts.weight(known_context, of_context)
        pv, pw = pairs // len(words), pairs % len(words)
        less = weight[pv] * below[pw]
        stored = np.flatnonzero(seen)
        with tempfile.TemporaryDirectory() as d:
            have, rank = np.unique(pv[stored], return_inverse=True)
            Trie.write(Path(d), contexts[have], UNIVERSE, rank, pw[stored], len(words), np.log10(seen[stored] + less[stored]))
            trie = Trie(Path(d))
            value = np.log10(less)
            for i in range(0, len(pairs), STEP):  # a slice at a time bounds what a search needs besides
                part = slice(i, i + STEP)
                near, at = np.unique(pv[part], return_inverse=True)
                got, found = trie.lookup(contexts[near], at, pw[part])
                value[part][found] = got[found]
            del trie
        score = value[of_pair] - np.log10(count + counts.weight(frequent, count))[w]
        base, known = np.log10(count + 1.0)[w], (count > 0)[w]
        for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            rows, at = np.unique(row[a:b], return_inverse=True)
            s = _sums(len(rows), at, score[a:b], base[a:b], known[a:b])
            out_data.append(pack(rows.astype("<u2"), s[0].astype("<f4"), s[1].astype("<f4"), s[2].astype("<u4")))
    data = [*out_data, *group.filter(pa.array(head)).column("data").to_pylist()]
    chunk = [*chunks[~head].tolist(), *chunks[head].tolist()]
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "head": pa.array([False] * len(out_data) + [True] * int(head.sum())), "data": pa.array(data, pa.binary())})


def join_chunk(group: pa.Table, counts: Counts) -> pa.Table:
    """One row a document from a chunk's head and its shards' sums."""
    head = group.column("head").to_numpy()
    ids, null, held, tokens, score, base, known = unpack(group.filter(pa.array(head)).column("data")[0].as_py(), "<i8", "?", "?", "<i8", "<f8", "<f8", "<i8")
    score, base, known = score.copy(), base.copy(), known.copy()
    messages = sorted(group.filter(pa.array(~head)).column("data").to_pylist())  # sums of floats in one order
    for x in messages:
        at, s, b, k = unpack(x, "<u2", "<f4", "<f4", "<u4")
        score[at] += s
        base[at] += b
        known[at] += k
    size = np.log10(counts.total + 1.0 * (counts.distinct + 1))
    return pa.table(
        {
            "doc_id": pa.array(ids, mask=null),
            "held_out": held,
            "n_tokens": tokens,
            "n_known": known,
            "train_tokens": np.full(len(ids), counts.total),
            "base_score": base - tokens * size,
            "score": score,
        }
    )


DEALT = "shard int, chunk bigint, head boolean, data binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", shard: int | None = None, every_context: bool = False) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows not held out.

    With ``every_context`` the weight m(v) goes by the exact count of any context, else only by that of a frequent one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // (shard or SHARD)))
    total, distinct, words, word_counts, maybe, owned = count_words(rows, shards)
    pair_counts = count_pairs(rows, maybe)
    hot = pair_counts * PAIRS >= max(total, 1)
    shared = spark.sparkContext.broadcast(Counts(total, distinct, words, word_counts, maybe[hot], pair_counts[hot], every_context))
    dealt = rows.mapInArrow(lambda it: deal_tokens(it, shared.value, shards), DEALT)
    if every_context:
        asked = rows.mapInArrow(lambda it: ask_contexts(it, shared.value, shards), "owner int, data binary")
        told = owned.groupBy("owner").cogroup(asked.groupBy("owner")).applyInArrow(lambda k, w, a: answer_contexts(k, w, a, shards), DEALT)
        dealt = dealt.unionByName(told)
    sums = dealt.groupBy("shard").applyInArrow(lambda t: score_shard(t, shared.value), "chunk bigint, head boolean, data binary")
    return sums.groupBy("chunk").applyInArrow(lambda t: join_chunk(t, shared.value), RESULT)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), held, every_context=True)


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}
