"""Telephony audio, quality rules and byte-level BPE against plain implementations."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platterlake.llm import byte_bpe, quality_rules, telephony

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_ulaw_and_alaw_known_values():
    assert telephony.ULAW[[0xFF, 0x7F, 0x00, 0x80]].tolist() == [0, 0, -32124, 32124]
    assert telephony.ALAW[[0xD5, 0x55, 0x2A, 0xAA]].tolist() == [8, -8, -32256, 32256]
    assert len(set(telephony.ALAW.tolist())) == 256
    assert (telephony.alaw_codes(telephony.ALAW) == np.arange(256)).all()


def slow_adpcm(block):
    steps, moves = telephony.STEPS.tolist(), [-1, -1, -1, -1, 2, 4, 6, 8]
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = steps[index]
            delta = step >> 3
            if nibble & 4:
                delta += step
            if nibble & 2:
                delta += step >> 1
            if nibble & 1:
                delta += step >> 2
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + moves[nibble & 7]))
            out.append(value)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=6))
def test_adpcm_blocks_equal_scalar_decoder(blocks):
    got = telephony.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 32))
    assert got.tolist() == [slow_adpcm(b) for b in blocks]


def test_to_pcm_and_unknown_encoding(spark):
    rows = spark.createDataFrame([(1, bytearray(range(256))), (2, bytearray()), (3, None)], "doc_id long, audio binary")
    for kind, samples in (("ulaw", 768), ("alaw", 768), ("adpcm", 505 * 3)):
        got = {r.id: r for r in telephony.to_pcm(rows, "audio", kind, factor=3).collect()}
        assert (got[1].samples, got[2].samples, got[3].samples) == (samples, 0, 0)
        pcm, rate = telephony.read_wav(bytes(got[1].wav))
        assert rate == 24000 and (pcm[::3] == telephony.decode(np.arange(256, dtype=np.uint8), kind)).all()
    with pytest.raises(ValueError):
        telephony.decode(np.zeros(1, np.uint8), "mp3")
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFFxxxxWAVE")


def test_media_digest(make_docs, odd_texts):
    got = {r.doc_id: r for r in telephony.media_digest(make_docs(odd_texts)).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        raw = (text or "").encode()
        payload = raw + bytes(max(-(-len(raw) // 64), 1) * 64 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        media = telephony.wav(telephony.upsample(telephony.ALAW[np.frombuffer(payload, np.uint8)], 2), 16000)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[10].feature == got[11].feature and len({r.feature for r in got.values()}) > 8
    assert telephony.media_digest(make_docs([])).count() == 0


def slow_feature(payload):
    """Mean square, peak and zero crossings of the three signals, one sample after another."""
    flat = telephony.ALAW[list(payload)].tolist()
    pcm = [x for a, b in zip(flat, [*flat[1:], flat[-1]], strict=True) for x in (a, a + (b - a) // 2)]
    adpcm = [x for i in range(0, len(payload), 64) for x in slow_adpcm(payload[i : i + 64])]
    told = lambda x: f"{sum(v * v for v in x) // len(x)}/{max(map(abs, x))}/{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"  # noqa: E731, B905
    return f"pcm={told(pcm)};ulaw={told(telephony.ULAW[list(payload)].tolist())};adpcm={told(adpcm)}"


def test_media_feature_equals_plain_computation(make_docs, odd_texts):
    texts = [t[:5000] if t else t for t in odd_texts]  # the slow version takes long over more
    for r in telephony.media_digest(make_docs(texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.feature == slow_feature(raw + bytes(max(-(-len(raw) // 64), 1) * 64 - len(raw)))


def test_null_and_repeated_ids_and_clashing_columns(make_docs, vocab):
    """Rows are independent: neither their ids nor other columns, whatever their names, change a result."""
    path, pattern, _, _ = vocab
    rows = [(1, "one two three one two three", "en", "s"), (1, "one two three one two three", "en", "s"), (1, "other", None, None), (None, "no id", "en", None), (None, None, "en", "s")]
    plain, clash = make_docs(rows), make_docs(rows)
    for c in ("n_bytes", "n_words", "n_tokens", "kept", "feature", "media_sha256", "ids", "row", "id", "score", "held_out", "__text"):
        clash = clash.withColumn(c, F.lit("clash"))
    for op in (telephony.media_digest, quality_rules.quality_cascade, lambda d: byte_bpe.encode_column(d, path, pattern)):
        one, two = (sorted(map(repr, op(d).collect())) for d in (plain, clash))
        assert one == two and len(one) == len(rows)
        by_id = Counter(r.doc_id for r in op(clash).collect())
        assert by_id == {1: 3, None: 2}
        assert max(Counter(one).values()) == 2  # equal rows, equal results


def slow_rules(text):
    text = text or ""
    words = WORD.findall(text)
    wins = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + j for i in range(len(words) - 4) if wins[tuple(words[i : i + 5])] > 1 for j in range(5)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    out = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(cover)]
    failed = len(words) < 10 or 100 * len(cover) > 20 * len(words)
    bare = sum(not re.search(r"[0-9A-Za-z]|[^\x00-\x7f]", w) for w in words)
    bad = 100 * out[2] > 30 * out[0] or 100 * bare > 30 * out[0] or 100 * out[3] > 30 * len(full) or not 2 * out[0] <= out[1] <= 20 * out[0]
    return [*out, failed, not failed and not bad]


def test_quality_rules(make_docs, odd_texts, spark):
    docs = make_docs([*odd_texts, "plain words that make one clean document of a fair length indeed yes", "a | b | c | d | e | f | g | h"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.quality_cascade(docs).collect():
        assert list(r)[1:] == slow_rules(texts[r.doc_id]), texts[r.doc_id]
    assert quality_rules.quality_cascade(make_docs([])).count() == 0


def test_cascade_order_follows_rejection_and_cost_but_not_the_verdict():
    import pyarrow as pa

    calls = []
    late = quality_rules.Rule("late", lambda v: calls.append(v.n) or np.zeros(v.n, bool))
    early = quality_rules.Rule("early", lambda v: np.arange(v.n) < v.n * 3 // 4)
    texts = pa.array(["a"] * 40)
    order = quality_rules.plan_cascade(texts, (early, quality_rules.Rule("slow", lambda v: [v.n_repeat_words, np.zeros(v.n, bool)][1])))
    assert [r.name for r in order] == ["early", "slow"]
    calls.clear()
    assert quality_rules.run_cascade(quality_rules.View(texts), (early, late)).tolist() == list(range(30, 40))
    assert calls == [10]


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    return path, P.PATTERN, byte_bpe.Codec(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_column_equals_library(make_docs, odd_texts, vocab):
    path, pattern, _, lib = vocab
    for r in byte_bpe.encode_column(make_docs(odd_texts), path, pattern, ids=True).collect():
        text = odd_texts[r.doc_id] or ""
        ids = lib.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_column(make_docs([]), path, pattern).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abé t'\n ", max_size=80)))
def test_bpe_equals_library(vocab, text):
    _, _, own, lib = vocab
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == lib.encode_ordinary(text)
    assert own.decode(got) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_bpe_equals_plain_merging_for_small_vocabularies(data):
    pieces = data.draw(st.lists(st.binary(min_size=2, max_size=5).map(lambda b: bytes(97 + x % 3 for x in b)), unique=True, max_size=25))
    ranks = {bytes([i]): i for i in range(256)}
    for p in pieces:
        ranks.setdefault(p, len(ranks))
    encoder = byte_bpe.Encoder(ranks)
    piece = bytes(97 + x % 3 for x in data.draw(st.binary(min_size=1, max_size=30)))
    want = [ranks[piece]] if piece in ranks else [ranks[p] for p in byte_bpe.merge(piece, ranks)]
    assert encoder.encode(piece) == want
