"""Quality rules as a short-circuit cascade.

Each rule rejects a document or lets it pass; a document is kept if no rule
rejects it.  The cascade estimates every rule's cost (seconds a document) and
selectivity (share rejected) on a sample, orders the rules by rejection per cost
and evaluates each only on the documents that all earlier rules let through.
What is known of a document (the counts that are columns of the result, and what
earlier rules computed) is carried along, so a rule's cost is what it adds.
The order changes the work, never the verdict.

Defined results: a null or empty text has no words, so it fails the base rules;
repeated rows get equal results; other columns are ignored; an empty table gives
an empty result.  Whole texts are read, whatever their length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_blocks, utf8
from ._words import Words, lines, mix, per_row, span_hashes, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: ASCII letters and digits, and every byte of a multi-byte character.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True


class feature(cached_property):
    """One number a row, which a view of some of the rows takes over once it is known."""


class View:
    """Texts of a block with their features, each computed once and only if asked for.

    A view of some rows of another keeps what is known of them; what is not is computed for those rows alone.
    """

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.n = len(texts)

    def take(self, keep: np.ndarray) -> View:
        view = View(self.texts.filter(pa.array(keep)))
        known = [name for name, kind in vars(View).items() if isinstance(kind, feature) and name in self.__dict__]
        view.__dict__.update({name: self.__dict__[name][keep] for name in known})
        return view

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return utf8(self.texts)

    @property
    def data(self) -> np.ndarray:
        return self._bytes[0]

    @property
    def off(self) -> np.ndarray:
        return self._bytes[1]

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.off)

    @feature
    def n_words(self) -> np.ndarray:
        return self.words.count

    @feature
    def word_chars(self) -> np.ndarray:
        return per_row(self.words.inside & ((self.data & 0xC0) != 0x80), self.off)

    @feature
    def n_symbols(self) -> np.ndarray:
        return per_row(SYMBOLS[self.data], self.off)

    @feature
    def n_bare_words(self) -> np.ndarray:
        """Words without a letter or digit."""
        w = self.words
        total = np.concatenate([[0], np.cumsum(WORDLIKE[self.data])])
        return np.bincount(w.doc[total[w.end] == total[w.start]], minlength=self.n)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        start, end, row = lines(self.data, self.off)
        total = np.concatenate([[0], np.cumsum(self.words.inside)])
        full = total[end] > total[start]
        start, end, row = start[full], end[full], row[full]
        return mix(span_hashes(self.data, start, end) + mix(row)), row

    @feature
    def n_lines(self) -> np.ndarray:
        return np.bincount(self._lines[1], minlength=self.n)

    @feature
    def n_dup_lines(self) -> np.ndarray:
        key, row = self._lines
        _, first = np.unique(key, return_index=True)
        return np.bincount(row, minlength=self.n) - np.bincount(row[first], minlength=self.n)

    @cached_property
    def _hashes(self) -> np.ndarray:
        return self.words.hashes()

    def _most(self, key: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each row's most frequent key."""
        _, first, n = np.unique(mix(key + mix(row)), return_index=True, return_counts=True)
        out = np.zeros(self.n, np.int64)
        np.maximum.at(out, row[first], n)
        return out

    @feature
    def n_top_word(self) -> np.ndarray:
        """Occurrences of the most frequent word."""
        return self._most(self._hashes, self.words.doc)

    @feature
    def n_top_pair(self) -> np.ndarray:
        """Occurrences of the most frequent pair of neighbouring words."""
        h, at = windows(self._hashes, self.words.doc, 2)
        return self._most(h, self.words.doc[at])

    @feature
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 5-word windows that occur at least twice in their own text."""
        w = self.words
        h, at = windows(self._hashes, w.doc, 5)
        h = mix(h + mix(w.doc[at]))
        order = np.argsort(h)
        s = h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = at[order[same[1:] | same[:-1]]]
        covered = np.zeros(len(w.start) + 5, bool)
        for i in range(5):
            covered[hit + i] = True
        return np.bincount(w.doc[covered[: len(w.doc)]], minlength=self.n)


#: Longest text of the sample that orders the rules.
SAMPLE_CHARS = 50_000
#: A view is cut down once one row in so many is out.
SHRINK = 3


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a View and returns one boolean a row."""

    name: str
    rejects: Callable[[View], np.ndarray]


def base_failed(v: View) -> np.ndarray:
    return (v.n_words < 10) | (100 * v.n_repeat_words > 20 * v.n_words)


#: Features that are columns of the result.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Integer comparisons, so that SQL gives the same verdicts.
RULES = (
    Rule("symbols", lambda v: 100 * v.n_symbols > 30 * v.n_words),
    Rule("bare_words", lambda v: 100 * v.n_bare_words > 30 * v.n_words),
    Rule("duplicate_lines", lambda v: 100 * v.n_dup_lines > 30 * v.n_lines),
    Rule("short_words", lambda v: v.word_chars < 2 * v.n_words),
    Rule("long_words", lambda v: v.word_chars > 20 * v.n_words),
    Rule("one_word", lambda v: 100 * v.n_top_word > 40 * v.n_words),
    Rule("one_pair", lambda v: 100 * 2 * v.n_top_pair > 40 * v.n_words),
)


def base_view(texts: pa.Array) -> View:
    """A view with the features that are columns of the result, which no rule has to pay for."""
    view = View(texts)
    for name in COUNTS:
        getattr(view, name)
    return view


def plan_cascade(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by estimated rejection per second on the sampled texts that pass the base rules; ties keep their order."""
    base = base_view(texts)
    base = base.take(~base_failed(base))
    if not base.n:
        return tuple(rules)
    gain, every = {}, np.ones(base.n, bool)
    for rule in rules:
        view = base.take(every)  # a new one each time: no rule profits from another's features
        began = time.perf_counter()
        rejected = rule.rejects(view)
        gain[rule.name] = (rejected.mean() + 0.5 / base.n) / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def run_cascade(view: View, rules: tuple[Rule, ...], alive: np.ndarray | None = None) -> np.ndarray:
    """Indices of the rows (of those ``alive``) that no rule rejects.

    Rows that are out leave the view, with all that is known of the others, once they are at least a SHRINK-th of it:
    words and hashes of the rest would have to be computed anew, which costs more than a few idle rows.
    """
    rows = np.arange(view.n)
    alive = np.ones(view.n, bool) if alive is None else alive.copy()
    for rule in rules:
        if (view.n - int(alive.sum())) * SHRINK >= view.n:
            rows, view, alive = rows[alive], view.take(alive), np.ones(int(alive.sum()), bool)
        if not len(rows):
            break
        alive &= ~rule.rejects(view)
    return rows[alive]


def sample_texts(docs: DataFrame, text_col: str, rows: int, seed: int = 11) -> pa.Array:
    """At most ``rows`` texts of at most SAMPLE_CHARS characters, drawn at random; they only order the rules."""
    some = docs.select(F.col(text_col).cast("string").alias("t")).where(F.length("t") <= SAMPLE_CHARS).sample(False, 0.25, seed).limit(rows).collect()
    return pa.array([r.t for r in some], pa.large_string())


def quality_cascade(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 300
) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    ordered = plan_cascade(sample_texts(docs, text_col, sample_rows), rules)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text"):
            view = base_view(b.column("text"))
            failed = base_failed(view)
            kept = np.zeros(view.n, bool)
            kept[run_cascade(view, ordered, ~failed)] = True
            counts = [getattr(view, name) for name in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(kept)],
                ["doc_id", *COUNTS, "base_failed", "kept"],
            )

    return chosen.mapInArrow(
        run,
        f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents", "doc_id", "text"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS k FROM pos),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win),
cov AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(0, 5)) AS j) WHERE c >= 2 GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM d),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
wc AS (SELECT rid, max(c) AS top_word FROM (SELECT rid, w, count(*) AS c FROM (SELECT rid, unnest(ws) AS w FROM w) GROUP BY rid, w) GROUP BY rid),
pc AS (SELECT rid, max(c) AS top_pair FROM (SELECT rid, k, count(*) AS c FROM (SELECT rid, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS k FROM w) GROUP BY rid, k) GROUP BY rid),
f AS (
  SELECT doc_id, coalesce(top_word, 0) AS top_word, coalesce(top_pair, 0) AS top_pair, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    len(list_filter(ws, lambda x: NOT regexp_matches(x, '[0-9A-Za-z\x{80}-\x{10FFFF}]'))) AS bare
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lc USING (rid) LEFT JOIN wc USING (rid) LEFT JOIN pc USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 30 * n_words OR 100 * bare > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 100 * top_word > 40 * n_words OR 200 * top_pair > 40 * n_words) AS kept
FROM b
"""

QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": OP9_SQL}
