"""Language identification by words first, then by ever shorter character n-grams.

A word known from training is scored by its log frequency in each language.  An
unseen word backs off: it is cut into character 5-grams (with word borders), and
each that was never seen is cut into its two 4-grams, and so on down to single
characters; the mean over what is found stands for the word.  A document's score
for a language is the sum over its words; the answer is the best language, and
its confidence the share of the document's evidence, by word, that agrees.

The model is fitted on a bounded sample of labelled rows: ``SAMPLE`` documents of
each language at most, smallest hash of the id first, none over ``LONGEST`` characters, and no more of them than
fit a language's equal part of ``CHARACTERS``.  It holds at most ``ENTRIES`` words or n-grams and
``VALUES`` log frequencies in all, so sample and model are bounded whatever the corpus and however many its
languages; the model is broadcast.

Defined results: null text, or text without a letter, gives ``und`` and 0; a letter
that no language knows tells nothing, and ties go to the first language by name;
repeated rows get equal results; rows with a null language are not learned from;
other columns are ignored; an empty table gives an empty result; with no labelled
rows every answer is ``und``.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, text_blocks, utf8
from ._words import mix, span_hashes

#: Labelled documents of a language in the sample, characters of one at most, entries of the model, lengths of n-grams.
SAMPLE, LONGEST, ENTRIES, ORDERS = 800, 200_000, 400_000, (5, 4, 3, 2, 1)
#: Characters of the whole sample, log frequencies of the whole model.
CHARACTERS, VALUES = 100_000_000, 16_000_000
#: Bytes of text that are counted at once while the model is fitted.
FIT_BLOCK = 1 << 18
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
BORDER = np.uint64(0x20)


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, and start, end and row of the runs of letters in them."""
    data, off = utf8(pc.utf8_lower(texts))
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = LETTER[data]
    cut = np.zeros(len(data) + 2, bool)
    cut[off + 1] = True
    now, before = inside[1:], inside[:-1]
    start = np.flatnonzero(now & (~before | cut[1:]))
    end = np.flatnonzero(before & (~now | cut[1:]))
    return data, start, end, np.searchsorted(off, start, "right") - 1


def characters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words, each word between two borders: points, and each word's first place and length."""
    size = end - start
    to = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
    lead = (flat & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    point = flat[at].astype(np.uint64)
    step = np.diff(np.append(at, len(flat)))
    for i in (1, 2, 3):
        more = step > i
        point[more] = (point[more] << np.uint64(8)) | flat[at[more] + i]
    count = np.searchsorted(at, to[1:]) - np.searchsorted(at, to[:-1])
    first = np.concatenate([[0], np.cumsum(count + 2)])
    out = np.full(first[-1], BORDER, np.uint64)
    out[np.arange(len(point)) + np.repeat(first[:-1] + 1 - np.concatenate([[0], np.cumsum(count)])[:-1], count)] = point
    return out, first[:-1], count + 2


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k characters from each place on; the last k - 1 places repeat earlier ones' values."""
    n = max(len(points) - k + 1, 0)
    h = np.full(len(points), np.uint64(k), np.uint64)
    for i in range(k):
        h[:n] = mix(h[:n] * np.uint64(31) + points[i : i + n])
    return h


@dataclass
class Model:
    """Sorted hashes of words and n-grams, and for each the log frequency in every language."""

    languages: list[str]
    keys: np.ndarray
    logs: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of several such parts together."""
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def _tally(parts: list[tuple[np.ndarray, np.ndarray]], hashes: np.ndarray) -> None:
    """Counts the hashes; parts of like size are merged, so that a key is held a few times at most, however many the blocks."""
    parts.append(np.unique(hashes, return_counts=True))
    while len(parts) > 1 and len(parts[-2][0]) <= 2 * len(parts[-1][0]):
        parts[-2:] = [_sum(parts[-2:])]


def _look_up(part: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Count of each key, 0 if it is not there."""
    at = np.searchsorted(part[0], keys)
    inside = np.append(part[0], np.uint64(0))[at] == keys
    return np.where(inside & (at < len(part[0])), np.append(part[1], 0)[at], 0)


def fit(texts: list[str], langs: list[str], entries: int = ENTRIES) -> Model:
    """Model of the labelled texts; half of the entries are words, the rest n-grams, the most frequent first.

    One language and FIT_BLOCK bytes of text at a time: beside the texts, only the keys that a language has are held, and
    counts by language only for the entries that the model keeps.
    """
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty(0, np.uint64), np.empty((0, 0)))
    by: dict[str, list[str]] = {x: [] for x in languages}
    for text, lang in zip(texts, langs, strict=True):
        by[lang].append(text)
    kinds: dict[int, list] = {k: [[] for _ in languages] for k in (0, *ORDERS)}
    for i, lang in enumerate(languages):
        for b in text_blocks(iter([pa.RecordBatch.from_arrays([pa.array(by[lang], pa.large_string())], ["t"])]), "t", FIT_BLOCK):
            data, start, end, _ = letter_words(b.column("t"))
            _tally(kinds[0][i], span_hashes(data, start, end))
            points, first, length = characters(data, start, end)
            left = np.repeat(first + length, length) - np.arange(len(points))  # characters of the word from each place on
            for k in ORDERS:
                _tally(kinds[k][i], gram_hashes(points, k)[left >= k])
    keys, logs = [], []
    for k in (0, *ORDERS):
        own = [_sum(parts) for parts in kinds.pop(k)]
        key, total = _sum(own)
        most = entries // 2 if k == 0 else entries // (2 * len(ORDERS))
        seen = total >= (2 if k == 0 else 1)  # a word met once tells less than its n-grams
        best = np.sort(np.argsort(-np.where(seen, total, -1), kind="stable")[: min(most, int(seen.sum()))])
        count = np.stack([_look_up(p, key[best]) for p in own], 1)
        rate = (count + 0.5) / (np.array([p[1].sum() for p in own]) + 0.5 * len(key))
        keys.append(key[best])
        logs.append(np.log(rate) - np.log(rate).mean(1, keepdims=True))  # only differences between languages count
    key, log = np.concatenate(keys), np.concatenate(logs)
    order = np.argsort(key)
    return Model(languages, key[order], log[order].astype(np.float32))


def word_scores(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A score for each word and language: the word's own, else that of its longest known n-grams."""
    hashes, at = np.unique(span_hashes(data, start, end), return_inverse=True)  # each different word once
    one = np.empty(len(hashes), np.int64)
    one[at] = np.arange(len(at))
    found = model.find(hashes)
    out = np.zeros((len(hashes), len(model.languages)), np.float32)
    known = found >= 0
    out[known] = model.logs[found[known]]
    left = np.flatnonzero(~known)
    if len(left):
        order = left[np.argsort(start[one[left]])]
        points, first, length = characters(data, start[one[order]], end[one[order]])
        word = np.repeat(np.arange(len(order)), length)
        place = np.arange(len(points)) - np.repeat(first, length)
        open_ = length[word] - place >= ORDERS[0]
        # Words shorter than the longest n-gram begin with the n-gram that they fill.
        total, n = np.zeros((len(order), len(model.languages))), np.zeros(len(order))
        for k in ORDERS:
            open_ |= (place == 0) & (length[word] == k)
            spots = np.flatnonzero(open_)
            row = model.find(gram_hashes(points, k)[spots])
            hit = row >= 0
            for i in range(total.shape[1]):
                total[:, i] += np.bincount(word[spots[hit]], model.logs[row[hit], i], len(order))
            n += np.bincount(word[spots[hit]], minlength=len(order))
            missed = spots[~hit]
            open_ = np.zeros(len(points), bool)
            open_[missed] = True  # its first k - 1 characters
            if k > 1:
                open_[missed + 1] = True  # and its last
        out[order] = total / np.maximum(n, 1)[:, None]
    return out[at]


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and confidence (0 to 1) of each text."""
    n, k = len(texts), len(model.languages)
    lettered = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    data, start, end, row = letter_words(texts)
    score = word_scores(model, data, start, end)
    total = np.stack([np.bincount(row, score[:, i], n) for i in range(k)], 1)
    best = total.argmax(1)
    gap = score.max(1) - score.min(1)  # a word's evidence
    for_best = np.maximum(score[np.arange(len(row)), best[row]] - score.min(1), 0)
    sure = np.bincount(row, for_best, n) / np.maximum(np.bincount(row, gap, n), 1e-9)
    sure = np.where(lettered, np.clip(sure, 0, 1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], sure


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Fit on the ``sample`` documents of smallest id hash in each language, as far as they fit its part of CHARACTERS."""
    rows = labelled.where((F.length(text_col) <= LONGEST) & F.col(lang_col).isNotNull())
    h = F.xxhash64(F.lit(3), F.col(id_col))
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # a row a language, like the model
    if not sizes:
        return fit([], [])
    total = sum(r["count"] for r in sizes)
    # Few more rows than needed reach the window: a hash threshold a language, from its count.
    parts = [(r.lang, min(1.0, 1.5 * sample / r["count"] + 20 / total)) for r in sizes]
    limits = labelled.sparkSession.createDataFrame([(x, min(int(-(1 << 63) + p * ((1 << 64) - 1)), (1 << 63) - 1)) for x, p in parts], "l string, most long")
    own = rows.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("lang"), h.alias("h"))
    own = own.join(F.broadcast(limits), (F.col("lang") == F.col("l")) & (F.col("h") <= F.col("most")))
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("t"))
    own = own.withColumn("n", F.row_number().over(order)).withColumn("chars", F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = own.where((F.col("n") <= sample) & ((F.col("n") == 1) | (F.col("chars") <= CHARACTERS // len(sizes)))).orderBy("lang", "n").collect()
    return fit([r.t for r in got], [r.lang for r in got], min(entries, VALUES // len(sizes)))


def identify(docs: DataFrame, model: Model, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns asked for, then lang_pred and score, for every row.  A text that is itself asked for is shipped once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = text_col in id_cols and dict(docs.dtypes)[text_col] == "string"
    text = text_col if whole else "__text"
    chosen = docs.select(*id_cols) if whole else docs.select(*id_cols, F.col(text_col).cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, text, 1 << 20):
            lang, score = predict(shared.value, b.column(text))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), pa.array(lang, pa.string()), pa.array(score)], [*id_cols, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in chosen.dtypes[: len(id_cols)])
    return chosen.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", parts: int = 3, out: int = 1) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo ``parts``, is ``out``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == out, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, learn(docs.where(~F.col("held_out"))), ("doc_id", "held_out"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
