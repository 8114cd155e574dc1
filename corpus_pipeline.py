"""Training-data pipeline over ``documents``: language, lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents`` (and any others that came with them); each works on all rows
that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm import byte_bpe, language_id, line_dedup, mixing, near_dedup
from platterlake.llm._shared import materialize, release, scope, table

#: Confidence under which a language is not accepted.
MIN_SCORE = 0.35

#: No SQL can express the language model, the schedule of the mix or BPE.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_tables(stage: Stage) -> Stage:
    """Deletes the working tables of the stage before, whose result has been written by now, and keeps this one's apart."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "stage")
        with scope("stage"):
            return stage(spark, docs, sf_dir)

    return run


@own_tables
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no text, no letters, no clear evidence); fills in a missing ``lang``.

    The model is learned from the rows that have a language.  Null and empty texts go; repeated rows get equal
    decisions; of languages with equal evidence the first by name is taken; further columns, whatever their names,
    are carried along; texts of any length are read whole; an empty table stays empty.
    """
    model = language_id.learn(docs)
    names = tuple(f"c{i}" for i in range(len(docs.columns)))
    text = names[docs.columns.index("text")]
    told = language_id.identify(docs.toDF(*names), model, names, text).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return told.select(*(F.coalesce(n, "lang_pred").alias(c) if c == "lang" else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


@own_tables
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; a document that loses all its words goes.

    Null and empty texts have no lines and stay; repeated rows are one document and lose the same lines; of equal
    runs the earliest by id (nulls first), hash of the text and line stays; further columns are carried along; texts of
    any length are read whole; an empty table stays empty.
    """
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("n_deleted") == 0) | F.col("kept_text").rlike(line_dedup.WORD))
    kinds = dict(docs.dtypes)
    changed = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast(kinds.get("n_chars", "bigint")).alias("n_chars")}
    return left.select(*(changed.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


@own_tables
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least by id (nulls last), then by a hash of the text.

    Texts without words link with nothing and stay; of rows equal in id and text one stays; further columns are
    carried along; texts of any length are read whole; an empty table stays empty.
    """
    return near_dedup.keep_one(docs)


@own_tables
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents by the schedule of the mix: some come more than once, some not at all.

    Null and empty texts have no words and are never taken; a null source comes last; repeated rows are separate
    copies; ties of the shuffle are broken by id and text; further columns are carried along; a text longer than a block
    is taken whole; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


@own_tables
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null or empty text has no ids; repeated rows get equal results; of equal merges the leftmost comes first; other columns
    are ignored; texts of any length are encoded whole; an empty table gives an empty result.
    """
    import public_tokenizers

    return byte_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again.

    One pipeline at a time in a session: a stage deletes the working tables of the stage before.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        with scope("pipeline"):
            docs = materialize(kept, name)
    return STAGES[-1][1](spark, docs, sf_dir)
