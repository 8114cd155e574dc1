"""The pipeline's stages, one by one against plain versions, and as a whole; the quality classifier."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platterlake.llm import language_id, quality_bayes
from tests.llm.test_corpus_ops import SAYS, WORD, shingles, slow_lines


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    word = lambda lang: rng.choice(SAYS[lang].split()) if rng.random() < 0.3 else "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda lang: "\n".join(" ".join(word(lang) for _ in range(rng.randrange(5, 20))) for _ in range(rng.randrange(2, 6)))
    rows = [(i, text(lang := rng.choice(list(SAYS))), lang, rng.choice("aaab")) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2], "c") for i in range(10)]
    rows += [(300 + i, rows[i][1].replace("the", "dhe", 1) + " tail", rows[i][2], "d") for i in range(20, 30)]
    return [*rows, (400, None, "en", "a"), (401, "", "en", "a"), (402, "12 34 !!", None, "a"), (403, "the and of to in", None, None)]


def test_stages(make_docs, corpus, spark, tmp_path):
    docs = make_docs(corpus).withColumn("row", F.lit("extra")).withColumn("score", F.lit(0.0))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "tokens"]
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = docs.collect()
    first = {r.doc_id: r for r in got["language"]}
    assert set(first) == {r[0] for r in corpus} - {400, 401, 402}
    assert first[403].lang == "en" and all(first[r[0]].text == r[1] and first[r[0]].lang == r[2] for r in corpus if r[0] < 400)
    want = slow_lines([(r.doc_id, r.text) for r in got["language"]], 2)
    kept = {i: w[3] for i, w in want.items() if not w[1] or WORD.search(w[3])}
    assert {r.doc_id: r.text for r in got["lines"]} == kept
    assert all(r.n_chars == len(r.text) for r in got["lines"])
    sets = {i: shingles(t) for i, t in kept.items()}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    stay = {r.doc_id for r in got["near_duplicates"]}
    assert stay <= set(kept) and all(not linked(a, b) for a in stay for b in stay if a < b)
    assert all(any(linked(a, b) for b in sets if b < a) for a in set(kept) - stay)
    n = Counter(r.doc_id for r in got["mix"])
    assert set(n) <= stay and max(n.values()) <= 3
    texts = {r.doc_id: r.text for r in got["mix"]}
    assert Counter(r.doc_id for r in got["tokens"]) == n
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens for r in got["tokens"])


def test_run_over_written_tables(make_docs, corpus, spark, tmp_path):
    make_docs(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    one, two = (sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and len(one) > 50


def test_pipeline_of_nothing(make_docs, spark, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(30, 80))]
        bad, rude = rng.random() < 0.2, rng.random() < 0.15
        if bad:
            words = [w + "###" for w in words]
        if rude:
            words[rng.randrange(len(words))] = rng.choice(["grumble", "snarl"])
        rows.append((i, " ".join(words), "en", "bad.org" if bad and rng.random() < 0.7 else rng.choice(["x.org", "y.org"])))
        labels.append((i, int(not bad), int(rude)))
    return rows, labels


def test_quality(make_docs, judged, spark, odd_texts):
    rows, labels = judged
    extra = [(1000 + i, t, None, None) for i, t in enumerate(odd_texts)] + [(None, "no id at all", "en", "x.org"), rows[0]]
    docs = make_docs([*rows, *extra]).withColumn("host", F.lit("clash")).withColumn("evidence", F.lit(1))
    told = spark.createDataFrame(labels[::2] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_bayes.score_quality(docs, told, "source", "lang").collect()
    assert len(got) == len(rows) + len(extra)
    good = {i: bool(q and not t) for i, q, t in labels}
    held = [r for r in got if r.doc_id in good and r.doc_id % 2]
    assert np.mean([r.kept == good[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert all(r.doc_score is None for r in got if (r.doc_id or 0) in (1000, 1001, 1002))
    assert quality_bayes.score_quality(make_docs([]), told, "source", "lang").count() == 0
    none = quality_bayes.score_quality(make_docs(["a b", None]), told.limit(0), "source", "lang").collect()
    assert sorted(str(r.doc_score) for r in none) == ["0.25", "None"]


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(i, "big", "p", 0.9, 2.2) for i in range(200)] + [(500 + i, "low", "q", 0.1, -2.2) for i in range(200)]
    rows += [(900, "one", "r", 0.1, -2.2), (901, "one", "r", 0.1, -2.2), (902, "big", "new", 0.5, 0.0)]
    got = {r.doc_id: r for r in quality_bayes.pooled(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double, logit double")).collect()}
    assert got[0].path_posterior > 0.85 and got[500].path_posterior < 0.15
    assert 0.1 < got[900].host_posterior < 0.5  # one other document moves it only partly
    assert got[902].path_posterior == pytest.approx(got[902].host_posterior) and got[902].host_posterior > 0.85


def slow_pooled(rows):
    """Posteriors and scores by the formulas, one document after another."""
    told = [r for r in rows if r[3] is not None]
    mean = sum(r[3] for r in told) / len(told)

    def strength(sites, parent):
        up = down = 0.0
        for site, p in sites.items():
            if len(p) > 1:
                m = sum(p) / len(p)
                noise = max(sum((x - m) ** 2 for x in p) / len(p), 0.0) / len(p)
                up += len(p) * ((m - parent(site)) ** 2 - noise)
                down += len(p)
        v = mean * (1 - mean)
        return min(max(v / (up / down) - 1, 1.0), 1e4) if down and up > 0 else 1e4

    hosts, paths = {}, {}
    for _, host, path, p, _ in told:
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)
    k_host = strength(hosts, lambda _: mean)
    k_path = strength(paths, lambda s: (k_host * mean + sum(hosts[s[0]])) / (k_host + len(hosts[s[0]])))
    odds = lambda p: np.log(p / (1 - p))
    out = []
    for i, host, path, p, logit in rows:
        rest = lambda site: (sum(site) - (p or 0.0), len(site) - (p is not None))  # noqa: E731, B023
        s, n = rest(hosts.get(host, []))
        of_host = (k_host * mean + s) / (k_host + n)
        s, n = rest(paths.get((host, path), []))
        of_path = (k_path * of_host + s) / (k_path + n)
        z = (odds(mean) if logit is None else logit) + odds(of_path) - odds(mean)
        out.append((i, of_host, of_path, 1 / (1 + np.exp(-z))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_equal_the_formulas(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        host, path = rng.choice(["a", "b", None, "c"]), rng.choice(["x", None, "y", "z"])
        p = None if rng.random() < 0.1 else round(min(max(rng.gauss({"a": 0.9, "b": 0.3}.get(host, 0.6) + {"x": 0.05}.get(path, 0), 0.1), 0.01), 0.99), 3)
        rows.append((i, host, path, p, None if p is None else float(np.log(p / (1 - p)))))
    rows += [(400, "lone", "x", 0.2, -1.4), (401, "void", None, None, None)]
    got = quality_bayes.pooled(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double, logit double")).collect()
    want = {r[0]: r[1:] for r in slow_pooled(rows)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.host_posterior, r.path_posterior, r.score) == pytest.approx(want[r.doc_id], rel=1e-6), r


def test_contradicting_labels_always_count_alike(make_docs, judged, spark):
    rows, labels = judged
    docs = make_docs(rows)
    told = [*labels, *((i, 1 - q, 1 - t) for i, q, t in labels[:200])]
    schema = "doc_id long, quality int, toxic int"
    one, two = (quality_bayes.learn(docs, spark.createDataFrame(x, schema).repartition(4), "doc_id", "text") for x in (told, told[::-1]))
    settled = [(i, 0, 1) for i, _, _ in labels[:200]] + labels[200:]
    want = quality_bayes.learn(docs, spark.createDataFrame(settled, schema), "doc_id", "text")
    for model in (one, two):
        assert (model.words == want.words).all() and np.allclose(model.weights, want.weights)


def test_samples_are_bounded_in_characters(make_docs, judged, spark, monkeypatch):
    rows, labels = judged
    seen = []
    monkeypatch.setattr(quality_bayes, "fit", lambda texts, got: seen.append(texts))
    monkeypatch.setattr(quality_bayes, "CHARACTERS", 5000)
    quality_bayes.learn(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "doc_id", "text")
    assert 4000 < sum(map(len, seen[0])) <= 5000
    monkeypatch.setattr(language_id, "fit", lambda texts, langs, entries: seen.append((texts, langs, entries)))
    monkeypatch.setattr(language_id, "CHARACTERS", 6000)
    monkeypatch.setattr(language_id, "VALUES", 300)
    language_id.learn(make_docs([(i, "word " * 20 if i % 3 else "w" * 9000, "abc"[i % 3], "s") for i in range(300)]))
    texts, langs, entries = seen[1]
    assert entries == 100 and Counter(langs) == {"a": 1, "b": 20, "c": 20}  # one text of a language always counts


def test_fitting_holds_little_beside_the_texts(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    langs = [rng.choice("abcd") for _ in range(1500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in langs]
    language_id.fit(texts[:10], langs[:10])  # tables that are made once
    tracemalloc.start()
    one = language_id.fit(texts, langs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak  # 3.3 MB of text; the driver keeps what this takes
    monkeypatch.setattr(language_id, "FIT_BLOCK", 1000)
    two = language_id.fit(texts, langs)
    assert one.languages == two.languages and (one.keys == two.keys).all() and (one.logs == two.logs).all()
