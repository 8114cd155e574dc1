"""Elias-Fano sequences, the trie, and corpus scores against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platterlake.llm import lm_scoring
from platterlake.llm._shared import utf8
from platterlake.llm._words import Words
from platterlake.llm.elias_fano import EliasFano, Trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 41), st.lists(st.integers(0, 1 << 41), max_size=40))
def test_elias_fano(tmp_path_factory, values, shift, asked):
    d = tmp_path_factory.mktemp("ef")
    values = sorted(v >> shift for v in values)
    universe = (values[-1] if values else 0) + 1
    EliasFano.write(d, "x", np.array(values, np.uint64), universe)
    ef = EliasFano(d, "x")
    if values:
        assert ef.access(np.arange(len(values))).tolist() == values
    asked = [min(a >> shift, universe - 1) for a in asked] + values
    if asked:
        place, hit = ef.successor(np.array(asked, np.uint64))
        assert hit.tolist() == [a in values for a in asked]
        if values:
            assert place.tolist() == [sum(v < a for v in values) for a in asked]


def test_elias_fano_is_compact(tmp_path):
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 100_000).astype(np.uint64))
    EliasFano.write(tmp_path, "x", v, 1 << 48)
    used = sum(p.stat().st_size for p in tmp_path.iterdir())
    assert used * 8 / len(v) < 2 + math.log2((1 << 48) / len(v)) + 6


def test_trie(tmp_path):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (700, 2))})
    contexts = np.array(sorted({a for a, _ in pairs}), np.uint64) * np.uint64(1 << 40)
    rank = {int(c) >> 40: i for i, c in enumerate(contexts)}
    values = rng.normal(size=len(pairs))
    Trie.write(tmp_path, contexts, 1 << 48, np.array([rank[a] for a, _ in pairs]), np.array([b for _, b in pairs]), 60, values)
    every = np.arange(64, dtype=np.uint64) * np.uint64(1 << 40)
    at, successor = np.repeat(np.arange(64), 60), np.tile(np.arange(60), 64)
    value, found = Trie(tmp_path).lookup(every, at, successor)
    want = dict(zip(pairs, values, strict=True))
    for a, s, v, f in zip(at.tolist(), successor.tolist(), value, found, strict=True):
        assert f == ((a, s) in want)
        if f:
            assert abs(v - want[a, s]) < 1e-3


def hash_of(word):
    return int(Words(*utf8(pa.array([word]))).hashes()[0])


def slow_scores(rows, table):
    """``table``: frequent words, as hashes."""
    texts = [WORD.findall((r[1] or "").translate({i: i + 32 for i in range(65, 91)})) for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    one, two = Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            one.update([*t, None])
            two.update(zip([None, *t], [*t, None], strict=True))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] - 0.6 if one[w] else 0.6 * v) / n
    m = lambda w: 4 + (0.8 * one[w] if (int(lm_scoring.END) if w is None else hash_of(w)) in table else 0)
    out = []
    for r, t, h in zip(rows, texts, held, strict=True):
        tokens = [*t, None]
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in tokens)
        score = sum(math.log10((two[a, w] + m(a) * p1(w)) / (one[a] + m(a))) for a, w in zip([None, *t], tokens, strict=True))
        out.append((r[0], h, len(tokens), sum(one[w] > 0 for w in tokens), n, base, score))
    return out


@pytest.mark.parametrize("frequent", [1 << 17, 25])
def test_scores(make_docs, odd_texts, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "PAIRS", 40)
    rng = np.random.default_rng(5)
    words = [f"W{i}é" for i in range(150)]
    texts = [" ".join(words[min(149, int(rng.exponential(25)))] for _ in range(rng.integers(0, 60))) for _ in range(120)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *odd_texts])] + [(None, "w1é w2é", "en", "s"), (3, texts[3], "en", "s"), (9, texts[4], "en", "s")]
    docs = make_docs(rows).withColumn("shard", F.lit("clash")).withColumn("held_out", F.lit(7))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    kept = {}
    plain = lm_scoring.count_words
    monkeypatch.setattr(lm_scoring, "count_words", lambda *a: kept.setdefault("x", plain(*a)))
    got = sorted((tuple(r) for r in lm_scoring.score_texts(docs, held, shard=20_000).collect()), key=repr)
    table = {int(h) for h in kept["x"][2]}
    want = sorted(slow_scores(rows, table), key=repr)
    assert len(got) == len(want) == len(rows)
    by = lambda x: (str(x[0]), x[2], round(x[5], 1))
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-5, abs=1e-3) and g[6] == pytest.approx(w[6], rel=2e-4, abs=5e-3)


class Every:
    def __contains__(self, x):
        return True


@pytest.mark.parametrize("frequent", [1 << 17, 25, 3])
def test_every_context_is_smoothed_by_its_count(make_docs, odd_texts, monkeypatch, frequent):
    """The table's size does not show in the scores, and a context of any count has the same rule."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "PAIRS", 40)
    rng = np.random.default_rng(6)
    words = [f"W{i}é" for i in range(150)]
    texts = [" ".join(words[min(149, int(rng.exponential(25)))] for _ in range(rng.integers(0, 60))) for _ in range(120)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, *odd_texts])] + [(None, "w1é w2é unmet w2é", "en", "s"), (3, texts[3], "en", "s")]
    monkeypatch.setattr(lm_scoring, "table", lambda *a: make_docs(rows))
    monkeypatch.setattr(lm_scoring, "SHARD", 4_000)
    got = [tuple(r) for r in lm_scoring.op3_lm_scoring(None, "").collect()]
    want = slow_scores(rows, Every())
    by = lambda x: (str(x[0]), x[2], round(x[5], 1))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-5, abs=1e-3) and g[6] == pytest.approx(w[6], rel=2e-4, abs=5e-3)


def test_probabilities_sum_to_one():
    c = lm_scoring.Counts(30, 4, *(np.array([], np.uint64), np.array([], np.int64)) * 2)
    known = np.array([20, 6, 3, 1])
    assert c.unigram(known).sum() + c.unigram(np.array([0]))[0] == pytest.approx(1)


def test_nothing_to_score_or_learn(make_docs):
    held = F.lit(True)
    assert lm_scoring.score_texts(make_docs([]), held).count() == 0
    got = lm_scoring.score_texts(make_docs(["a b", None]), held).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
