"""Quality by hierarchical empirical Bayes: a document classifier, hosts and paths.

A document's own evidence is the probability of two logistic models that it is of
quality and not toxic (features: shares of symbols, capitals, repeats and the like,
and the presence of words that tell the classes apart).  Evidence is then pooled: the
mean of each host is shrunk toward the global mean, and that of each path within its
host toward the host's posterior, both as beta posteriors whose prior strength is
estimated from the spread of the means (method of moments).  Sparse sites stay near
their parents, rich ones speak for themselves.  A document's score is its own odds
times the odds that its path, without it, adds to the global ones.

The models are fitted on at most ``SAMPLE`` labelled documents (smallest hash of the
id first, none over ``LONGEST`` characters, ``CHARACTERS`` in all, near copies once) with ``WORDS`` words a
model at most; everything else covers all documents by grouped aggregation.

Scale: the models' size is bounded, so they are broadcast; sums by host and path are
partial aggregates; the joins back have one row a host or path on one side, so
adaptive execution can split a host with a third of the rows.

Defined results: a null or empty text has no evidence and scores as its path without
it; a null host or path is a site of its own; rows whose label is null are not learned
from; of contradicting labels of one id the lower quality and the toxic one count; without labels of both classes a model says 1/2 for
all; repeated rows are separate documents; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table, text_blocks
from ._words import LOWER, span_hashes
from .near_dedup import band_values, minhash, shingle_sets
from .quality_rules import View

SAMPLE, LONGEST, WORDS, CHARACTERS = 4000, 50_000, 250, 60_000_000
#: Texts of the sample that are read at once.
STEP = 200
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


def letter_runs(view: View) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased run of letters, and its row."""
    inside = np.zeros(len(view.data) + 2, bool)
    inside[1:-1] = LETTER[view.data]
    cut = np.zeros(len(view.data) + 2, bool)
    cut[view.off + 1] = True
    now, before = inside[1:], inside[:-1]
    start, end = np.flatnonzero(now & (~before | cut[1:])), np.flatnonzero(before & (~now | cut[1:]))
    return span_hashes(LOWER[view.data], start, end), np.searchsorted(view.off, start, "right") - 1


def shares(view: View) -> np.ndarray:
    """Features that need no vocabulary, one row a text."""
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[view.off])
    n = np.maximum(view.n_words, 1)
    w = view.words
    h = w.hashes()
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    return np.stack(
        [
            np.log1p(view.n_words) / 10,
            np.minimum(view.n_symbols / n, 3),
            np.minimum(total(view.data == 33) / n, 3),
            view.n_bare_words / n,
            total(UPPER[view.data]) / np.maximum(total(LETTER[view.data]), 1),
            np.bincount(w.doc[again], minlength=view.n) / n,
            view.n_repeat_words / n,
            view.n_dup_lines / np.maximum(view.n_lines, 1),
            np.ones(view.n),
        ],
        1,
    )


@dataclass
class Model:
    """Sorted hashes of words, and weights for them and for the shares, one column a label."""

    words: np.ndarray
    weights: np.ndarray

    def logits(self, view: View) -> np.ndarray:
        h, row = letter_runs(view)
        x = shares(view)
        out = x @ self.weights[len(self.words) :]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            row, at = np.divmod(np.unique(row[hit] * len(self.words) + at[hit]), len(self.words))  # presence, not number
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(row, self.weights[at, k], view.n)
        return out


def _newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(texts: list[str], labels: np.ndarray, words: int = WORDS) -> Model:
    """``labels``: one row a text, one column a model, 0 or 1."""
    if not len(texts):
        return Model(np.empty(0, np.uint64), np.zeros((9, labels.shape[1])))
    seen: set[int] = set()
    first: list[int] = []
    parts: list[tuple[np.ndarray, ...]] = []
    for i in range(0, len(texts), STEP):  # a few texts at a time bound the memory
        block = pa.array(texts[i : i + STEP], pa.large_string())
        own = []
        for k, s in enumerate(shingle_sets(block)):  # copies would teach the words of one text as if many had them
            bands = set(band_values(minhash(s)).tolist()) if len(s) else set()
            if not bands & seen:
                own.append(k)
            seen |= bands
        view = View(block.take(pa.array(own, pa.int64())))
        h, row = letter_runs(view)
        u, at = np.unique(h, return_inverse=True)
        row, at = np.divmod(np.unique(row * max(len(u), 1) + at), max(len(u), 1))
        parts.append((u[at], row + len(first), shares(view)))
        first += [i + k for k in own]
    labels = labels[first]
    hashes, row, features = (np.concatenate([p[k] for p in parts]) for k in range(3))
    del parts
    keys, at = np.unique(hashes, return_inverse=True)
    n = np.bincount(at, minlength=len(keys))
    chosen: set[int] = set()
    for k in range(labels.shape[1]):
        y = labels[:, k]
        share = y.mean()
        if not 0 < share < 1:
            continue
        ones = np.bincount(at, y[row], len(keys))
        z = (ones - n * share) / np.sqrt(np.maximum(n * share * (1 - share) * (1 - n / len(y)), 1e-9))
        z[n < 5] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:words]
        chosen |= set(best[np.abs(z[best]) > 4].tolist())  # the rest may be chance
    order = np.array(sorted(chosen), np.int64)
    x = np.zeros((len(first), len(order) + 9))
    place = np.full(len(keys), -1)
    place[order] = np.arange(len(order))
    used = place[at] >= 0
    x[row[used], place[at[used]]] = 1
    x[:, len(order) :] = features
    weights = np.zeros((x.shape[1], labels.shape[1]))
    for k in range(labels.shape[1]):
        if 0 < labels[:, k].mean() < 1:
            weights[:, k] = _newton(x, labels[:, k])
    return Model(keys[order], weights)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int = SAMPLE) -> Model:
    """Fit on the ``sample`` labelled documents of smallest id hash."""
    h = F.xxhash64(F.lit(8), F.col("id"))
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t")).dropna()
    n = marked.count()
    limit = int(-(1 << 63) + min(1.0, (1.5 * sample + 50) / max(n, 1)) * ((1 << 64) - 1))
    some = marked.where(h <= F.lit(min(limit, (1 << 63) - 1))).groupBy("id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= LONGEST)
    first = texts.join(some, "id").withColumn("h", h).orderBy("h", F.xxhash64("text")).limit(sample)
    before = Window.orderBy("h", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0)  # over ``sample`` rows at most
    got = first.withColumn("chars", F.sum(F.length("text")).over(before)).where(F.col("chars") <= CHARACTERS).collect()
    return fit([r.text for r in got], np.array([[r.q, r.t] for r in got]).reshape(-1, 2))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def strength(between: float | None, mean: float) -> float:
    """Prior observations of a beta distribution with this mean and variance; 1 to 10,000."""
    v = mean * (1 - mean)
    return float(np.clip(v / between - 1 if between and between > 0 else 1e4, 1, 1e4))


def moments(sites: DataFrame, parent: Column) -> float | None:
    """Variance of the sites' true means about ``parent``: that of the observed ones less what sampling adds.

    ``sites`` has n, p (sum of evidence) and pp (sum of squares).
    """
    mean = F.col("p") / F.col("n")
    noise = F.greatest(F.col("pp") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")
    got = sites.where("n > 1").agg(F.sum(F.col("n") * ((mean - parent) ** 2 - noise)).alias("v"), F.sum("n").alias("n")).first()
    return got.v / got.n if got.n else None


def pooled(docs: DataFrame) -> DataFrame:
    """From (doc_id, host, path, evidence, logit): the columns of the result."""
    sums = [F.count("evidence").alias("n"), F.sum("evidence").alias("p"), F.sum(F.col("evidence") ** 2).alias("pp")]
    paths = materialize(docs.groupBy("host", "path").agg(*sums), "bayes-paths").fillna(0.0, ["p", "pp"])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("pp").alias("pp"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).first()
    mean = whole.p / whole.n if whole.n else 0.5
    k_host = strength(moments(hosts, F.lit(mean)), mean)
    named = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("p").alias("host_p"))
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    of_host = (k_host * mean + F.col("host_p")) / (k_host + F.col("host_n"))
    k_path = strength(moments(joined, of_host), mean)
    sites = joined.select(F.col("host").alias("h"), F.col("path").alias("s"), "n", "p", "host_n", "host_p")
    rows = docs.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("s")))
    own, one = F.coalesce("evidence", F.lit(0.0)), F.col("evidence").isNotNull().cast("int")
    # A document does not speak for its own site.
    host = (k_host * mean + F.col("host_p") - own) / (k_host + F.col("host_n") - one)
    path = (k_path * F.col("host_posterior") + F.col("p") - own) / (k_path + F.col("n") - one)
    score = F.coalesce("logit", _logit(F.lit(mean))) + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    rows = rows.withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("score", 1 / (1 + F.exp(-score)))
    return rows.select("doc_id", F.col("evidence").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= 0.5).alias("kept"))


def score_quality(docs: DataFrame, labels: DataFrame, host_col: str, path_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, doc_score (own evidence), host_posterior, path_posterior, score, kept (score of 1/2 or more)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, sample))
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text", 1 << 20):
            view = View(b.column("text"))
            z = np.clip(model.value.logits(view), -30, 30)
            good = 1 / (1 + np.exp(-z[:, 0])) / (1 + np.exp(z[:, 1]))
            none = view.n_words == 0
            logit = np.log(good) - np.log1p(-np.minimum(good, 1 - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(good, mask=none), pa.array(logit, mask=none)], ["doc_id", "host", "path", "evidence", "logit"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return pooled(materialize(chosen.mapInArrow(run, f"doc_id {kind}, host string, path string, evidence double, logit double"), "bayes-evidence"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources; a path is a language within its source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return score_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), "source", "lang")


QUERIES = {"op8_quality_bayes": op8_quality_bayes}
ORACLES: dict[str, str] = {}
