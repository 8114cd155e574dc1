"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Every source's documents are put in a shuffled order (by hash) on a line of words,
which is cut into blocks of equal numbers of words.  The schedule has one slot a
block: slot i takes the golden-ratio point frac(i * phi), the point falls into one
source's interval of cumulative weights, and the slot's rank among that source's
slots names the block it takes, going round the source's blocks again when they
run out.  Golden-ratio points fill every interval evenly, so any stretch of the
schedule has each source near its weight.

Scale: nothing is ordered globally and no source is gathered in one task.  Ranks
and positions come from counts per chunk or hash bucket, prefix sums over those
counts, and windows inside a chunk or bucket.  Only the table of sources (a row a
source) is handled by one task.

Defined results: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; repeated rows are separate documents; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
#: Words in a block at most; blocks that a source's target has at least; times that a word is taken at most.
BLOCK, BLOCKS, REPEATS = 2048, 1024, 3
#: Slots ranked by one window; documents of a hash bucket, and buckets at most.
CHUNK, BUCKET, BUCKETS = 4096, 512, 1 << 20
PHI = Fraction(10610209857723, 17167680177565)  # Fibonacci numbers F(64)/F(65): the golden ratio's fraction to 1e-26


def word_count(text: Column) -> Column:
    """Number of runs other than white space (0x20, 0x09-0x0D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, text_col: str, source_col: str, seed: int, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows ``(row, source, size, h)``: ``row`` has the columns to keep (all), ``h`` shuffles the documents."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), text, *[F.col(c) for c, t in docs.dtypes if t in ("bigint", "int", "string") and c != text_col]).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """A row a source: sid, weight, source_size, target, n (blocks), lo and hi of its interval, slots (of all).

    Targets share the size of all sources by weight and stop at REPEATS times the
    source's size; the excess is shared again by weight.  That is the level L at
    which sum(min(REPEATS * size, L * weight)) is the total: sources are sorted by
    size over weight, and those before the first that L does not fill are full
    (further down the sort the same formula gives lower levels, so L is the greatest).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", w)
    rows = rows.withColumn("cap", REPEATS * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.partitionBy(F.lit(0))
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight")))
    )
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / blocks)))
    rows = rows.withColumn("n", F.ceil(F.col("source_size") / length).cast("long"))
    rows = rows.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("n") / F.col("source_size")).otherwise(0.0))
    by_sid = Window.orderBy("sid")  # one order of adding, so that reruns agree to the last bit
    before = F.sum("share").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)) - F.col("share")
    rows = rows.withColumn("slots", F.sum("share").over(by_sid.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("lo", before / F.greatest(F.col("slots"), F.lit(1e-300)))
    rows = rows.withColumn("hi", F.lead("lo", 1, 2.0).over(Window.orderBy("sid")))
    return rows.select("source", "sid", "weight", "source_size", "target", "n", "lo", "hi", "slots")


def golden(i: Column) -> Column:
    """frac(i * phi) to about 1e-10 for i below 2**40: the index is split so that no product loses its fraction."""
    low, high = i.bitwiseAND(F.lit((1 << 20) - 1)), F.shiftright(i, 20)
    u = low * F.lit(float(PHI)) + high * F.lit(float(PHI * (1 << 20) % 1))
    return u - F.floor(u)


def schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Rows ``(slot, sid, rank, block, turn)``; turn counts how often the source began again."""
    counted = sources.agg(F.round(F.max("slots")).cast("long").alias("n"), F.count("*").alias("sources")).first()
    cells = 1 << max(6, (4 * counted.sources).bit_length())
    top = F.lit(cells - 1)
    # An interval is met by equal cells of [0, 1), so points find theirs by an equi-join.
    meets = sources.where("hi > lo and lo < 1").select(
        "sid", "lo", "hi", "n", F.explode(F.sequence(F.least(F.floor(F.col("lo") * cells), top), F.least(F.floor(F.col("hi") * cells), top))).alias("cell")
    )
    points = spark.range(counted.n or 0).select(F.col("id").alias("slot"), golden(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells))
    found = points.join(meets, "cell").where("u >= lo and u < hi").select("slot", "sid", "n", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = found.groupBy("sid", "chunk").agg(F.count("*").alias("c")).select("sid", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return (
        found.join(base, ["sid", "chunk"])
        .select("slot", "sid", "n", rank.alias("rank"))
        .select("slot", "sid", "rank", F.expr("rank % n").alias("block"), F.expr("rank div n").alias("turn"))
        .where(F.col("turn") < REPEATS)
    )


def place(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each row its source's sid, n, source_size, target, and ``at``: words before it on the source's line."""
    rows = sizes.count()
    buckets = min(BUCKETS, max(1, rows // BUCKET))
    placed = sizes.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight", "lo", "hi", "slots")
    placed = placed.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        placed.groupBy("sid", "bucket")
        .agg(F.sum("size").alias("c"))
        .select("sid", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    at = F.col("base") + F.sum("size").over(inside) - F.col("size")
    return placed.join(base, ["sid", "bucket"]).withColumn("at", at).drop("base", "bucket")


_Q, _REM = "(source_size div greatest(n, 1))", "(source_size % greatest(n, 1))"  # a source without words has no block


def block_of(word: str) -> Column:
    """Block that holds a word of the source's line: the first blocks have one word more than the rest."""
    return F.expr(f"if({word} < {_REM} * ({_Q} + 1), {word} div ({_Q} + 1), {_REM} + ({word} - {_REM} * ({_Q} + 1)) div greatest({_Q}, 1))")


def block_start(block: str) -> Column:
    return F.expr(f"{block} * {_Q} + least({block}, {_REM})")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 1, keep: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, slots, pieces)`` of the mix.

    ``slots`` is the schedule.  ``pieces`` has a row for each block that a document
    has words in: row (the document), size, source_size, target, sid, at, block,
    words (of the document in the block) and uses (slots that take the block);
    documents without words have one row without a block.
    """
    spark = docs.sparkSession
    sizes = materialize(sized(docs, text_col, source_col, seed, keep), "mix-sizes")
    sources = materialize(targets(sizes, weights), "mix-sources")
    slots = schedule(spark, sources)
    uses = slots.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    placed = place(sizes, sources).withColumn("last", F.col("at") + F.col("size") - 1)
    cut = (
        placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(block_of("at"), block_of("last")))))
        .withColumn("words", F.least(F.col("last") + 1, block_start("(block + 1)")) - F.greatest(F.col("at"), block_start("block")))
        .drop("last")
    )
    return sources, slots, cut.join(uses, ["sid", "block"], "left")


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """Whole documents of the mix, with the columns of ``docs``.

    A document belongs to the block that holds its first word and comes once for
    every slot that takes that block; documents without words never come.
    """
    _, _, pieces = mix(docs, text_col, source_col, weights, seed)
    first = pieces.where("uses > 0").where(block_of("at") == F.col("block"))
    return first.select("row", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, pieces = mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"), keep=("doc_id",))
    # (sid, at) names a document with words; the empty ones are told apart by their own row.
    taken = F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).cast("long")
    some = pieces.where("size > 0").groupBy("sid", "at").agg(
        F.first("row.doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), taken.alias("taken")
    )
    none = pieces.where("size = 0").select("row.doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.select("doc_id", "size", "source_size", "target", "taken").unionByName(none)


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
