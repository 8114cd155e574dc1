"""Near-duplicate documents by MinHash bands, odd sketches and confirmation on full sets.

1. Every text becomes its set of 5-word shingles.  Texts with equal sets are one
   class, whatever their number; only classes go on.
2. A class has a MinHash sample (BANDS x ROWS permutations).  Bands of equal values
   meet in buckets.  The sample is also folded into an odd sketch: each (permutation,
   value) flips one of BITS bits, so the exclusive or of two sketches holds one flip
   for each sample that differs, and its population count estimates the similarity.
   A second odd sketch folds the whole set: its differing bits are never more than the
   shingles that only one of two sets has, of which linked sets have at most a seventh
   of their sizes' sum, so this test drops no link.
3. In each bucket every class is paired with the one whose buckets hold most classes.
   Pairs whose sketches differ too much are dropped, the rest confirmed on the full sets.
4. Confirmed links join classes into components.  The classes of buckets that still
   hold different components are searched again by an exact prefix filter: their
   shingles are ordered by frequency, and two sets at the level share one that comes
   early in both, the earlier the more alike they are.  Texts that share a template
   meet in its shingles only if the template is enough for a link, so such a bucket does
   not cost the square of its size.  Sketches and full sets decide as before.  A pair
   within one component needs no test, as its link would change nothing.

Chances: a pair of similarity 0.75 shares no band with probability 3e-7
((1 - 0.75 ** 4) ** 40), and has more than FLIPS differing sketch bits with about
1e-8; both fall quickly with higher similarity.  Nothing else is approximate: a link
is decided by 100 * intersection >= 75 * union of the full sets.

Scale: groups of copies are aggregated before they are shuffled; a bucket's center
is a partial aggregate; joins on a hot bucket or class have one row a key on
one side, so adaptive execution can split them.  Components are found by hooking and
pointer jumping on written tables; nothing is collected to the driver but counts.

Defined results: a null text, or one without words, has an empty set (n_shingles 0),
links with nothing and stays; fewer than five words are one shingle; rows with equal
id and text get equal results; null ids are never chosen as a component's name unless
it has no other, and are marked as kept only then (:func:`keep_one` keeps a single
text of a component all the same); other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table, text_blocks, utf8
from ._words import Words, mix, windows

SHINGLE = 5
BANDS, ROWS = 40, 4
#: Bits of an odd sketch, and the most that may differ: over five standard deviations (of 10) above the 74 that similarity 0.75 gives.
BITS, FLIPS = 1024, 130
#: Similarity in hundredths.
LEVEL = 75
#: Classes of a shingle that are compared by one task with as many others.
BLOCK = 512

_RANDOM = np.random.default_rng(5)
_ADD = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(*utf8(texts), lower=True)
    hashes = w.hashes()
    h, at = windows(hashes, w.doc, SHINGLE)
    cut = np.searchsorted(w.doc[at], np.arange(len(texts) + 1))
    out = [np.unique(h[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    for i in np.flatnonzero((w.count > 0) & (w.count < SHINGLE)):
        own = hashes[w.first[i] : w.first[i] + w.count[i]]
        out[i] = windows(own, np.zeros(len(own), int), len(own))[0]
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """Least value of the set under each permutation."""
    out = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for i in range(0, len(shingles), 1024):
        np.minimum(out, ((shingles[i : i + 1024, None] ^ _ADD) * _TIMES).min(0), out=out)
    return out


def band_values(sample: np.ndarray) -> np.ndarray:
    """One value a band; bands do not mix."""
    v = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        v = mix(v + sample.reshape(BANDS, ROWS)[:, i])
    return v


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (permutation, value) pairs, as 64-bit words."""
    bit = (mix(sample + mix(np.arange(len(sample), dtype=np.uint64))) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap of a whole set."""
    bit = (mix(shingles + np.uint64(0x0DD)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=BITS) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def similarity(flips: np.ndarray) -> np.ndarray:
    """Estimate of the similarity from the number of differing sketch bits."""
    k = BANDS * ROWS
    return 1 + BITS / (4 * k) * np.log(np.maximum(1 - 2 * np.asarray(flips) / BITS, 1e-9))


def _longs(x: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]), pa.int32()), pa.array(flat))


def _name(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128-bit name of a set."""
    return mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5DEECE66D1234567)).sum(dtype=np.uint64)


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(17), text).alias("b"))


def _row_key(id_: Column, key: Column) -> tuple[Column, Column]:
    """128-bit name (ka, kb) of an id and a text's key."""
    return F.xxhash64(id_, key["a"], key["b"]).alias("ka"), F.xxhash64(F.lit(31), id_, key["a"], key["b"]).alias("kb")


def features(docs: DataFrame) -> DataFrame:
    """From (doc_id, text): doc_id, key (of the text), n, c (name of the set), bands, sketch, whole (the set's own sketch)."""
    chosen = docs.select("doc_id", _text_key(F.col("text")).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text", 1 << 20):
            sets = shingle_sets(b.column("text"))
            names = np.array([_name(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            samples = [minhash(s) if len(s) else None for s in sets]
            none = np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.StructArray.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())], ["a", "b"]),
                    _longs([none if m is None else band_values(m) for m in samples]),
                    _longs([none if m is None else odd_sketch(m) for m in samples]),
                    _longs([set_sketch(s) if len(s) else none for s in sets]),
                ],
                ["doc_id", "key", "n", "c", "bands", "sketch", "whole"],
            )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, key struct<a:bigint,b:bigint>, n bigint, c struct<a:bigint,b:bigint>, bands array<bigint>, sketch array<bigint>, whole array<bigint>")


def full_sets(docs: DataFrame) -> DataFrame:
    """From (c, text): c and the text's full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column("c"), _longs(shingle_sets(b.column("text")))], ["c", "shingles"])

    return docs.select("c", "text").mapInArrow(run, "c struct<a:bigint,b:bigint>, shingles array<bigint>")


def _differ(one: Column, two: Column) -> Column:
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def likely(one: str, two: str) -> Column:
    """Whether two classes, given as structs (n, sketch, whole), may be linked."""
    a, b = F.col(one), F.col(two)
    n = a["n"] + b["n"]
    sizes = 100 * F.least(a["n"], b["n"]) >= LEVEL * F.greatest(a["n"], b["n"])
    return sizes & (_differ(a["sketch"], b["sketch"]) <= FLIPS) & (_differ(a["whole"], b["whole"]) * (100 + LEVEL) <= (100 - LEVEL) * n)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (c, d) of classes whose full sets reach the level."""
    both = pairs.join(sets, "c").withColumnRenamed("shingles", "one").join(sets.withColumnsRenamed({"c": "d", "shingles": "two"}), "d")
    common = F.size(F.array_intersect("one", "two"))
    return both.where(100 * common >= LEVEL * (F.size("one") + F.size("two") - common)).select("c", "d")


def components(edges: DataFrame) -> DataFrame:
    """Rows (c, root) for the ends of the edges (c, d): root is one class of the component.

    Each round lets every root hook onto its smallest neighbouring root, follows the
    hooks to their ends, and contracts the edges; the number of components that still
    have edges at least halves, so rounds grow with the logarithm of their number.
    ``edges`` is read several times and should be a written table.
    """
    labels = edges.select("c").union(edges.select("d")).distinct().select("c", F.col("c").alias("root"))
    left = edges.select(F.col("c").alias("x"), F.col("d").alias("y"))
    while not left.isEmpty():
        both = left.union(left.select("y", "x"))
        hooks = materialize(both.groupBy("x").agg(F.min("y").alias("p")).where("p < x"), "near-hooks")
        while True:
            ends = hooks.select(F.col("x").alias("p"), F.col("p").alias("q"))
            longer = materialize(hooks.join(ends, "p", "left").select("x", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "near-hooks")
            hooks = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        to = hooks.select(F.col("x").alias("root"), "p")
        labels = materialize(labels.join(to, "root", "left").select("c", F.coalesce("p", "root").alias("root")), "near-labels")
        x, y = hooks.select("x", F.col("p").alias("px")), hooks.select(F.col("x").alias("y"), F.col("p").alias("py"))
        left = left.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"))
        left = materialize(left.where("x != y").distinct(), "near-left")
    return labels


def extended(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels as of :func:`components` after further edges: only components that these join are worked on."""
    ends = [labels.select(F.col("c").alias(f"{x}0"), F.col("root").alias(f"{x}1")) for x in "cd"]
    over = more.join(ends[0], F.col("c") == F.col("c0"), "left").join(ends[1], F.col("d") == F.col("d0"), "left")
    over = over.select(F.coalesce("c1", "c").alias("c"), F.coalesce("d1", "d").alias("d")).where("c != d").distinct()
    to = components(materialize(over, "near-over")).select(F.col("c").alias("root"), F.col("root").alias("to"))
    new = to.join(labels.select(F.col("c").alias("known")), F.col("root") == F.col("known"), "left_anti").select(F.col("root").alias("c"), F.col("to").alias("root"))
    return materialize(labels.join(to, "root", "left").select("c", F.coalesce("to", "root").alias("root")).unionByName(new), "near-labels")


def prefixes(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """From classes (c, root, n): (t, c, root, n, at) for the shingles t that a partner of ``c`` may share first.

    Shingles are ordered by the number of classes that have them, then by value; ``at`` is a shingle's place in
    its set.  Sets at the level share LEVEL / 100 of either, so the first shingle that they share has no more than the
    rest of the set before it.  Shingles of one class only come before all others and need no rows.
    """
    # Rows of shingles have a number for their class, of which few bytes are left once compressed.
    classes = materialize(classes.withColumn("k", F.monotonically_increasing_id()), "near-numbered")
    shingles = classes.join(sets, "c").select("k", F.explode("shingles").alias("t"))
    shared = shingles.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    of_class = Window.partitionBy("k")
    left = F.count("*").over(of_class) - F.row_number().over(of_class.orderBy("f", "t")) + 1
    placed = shingles.join(shared, "t").select("k", "t", left.alias("left")).join(classes, "k").where(100 * F.col("left") >= LEVEL * F.col("n"))
    return materialize(placed.select("t", "c", "root", "n", (F.col("n") - F.col("left")).alias("at")), "near-prefixes")


def across(prefix: DataFrame) -> DataFrame:
    """Pairs (c, d), c < d, of classes of different components that may share enough, from rows of :func:`prefixes`.

    The smaller set of a pair shares at least 2 * LEVEL / (100 + LEVEL) of itself, so it is found by a shorter prefix:
    texts of one template, which share less than that, do not even meet in its shingles.  Of a shingle the component with
    most classes never meets itself.  Classes of a shingle meet in cells of BLOCK x BLOCK.
    """
    roots = prefix.groupBy("t", "root").agg(F.count("*").alias("size"))
    held = roots.groupBy("t").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    minor, major = (F.ceil(x / BLOCK).cast("int") for x in (F.col("size") - F.col("most.size"), F.col("most.size")))
    held = held.select("t", F.col("most.root").alias("main"), minor.alias("minor"), major.alias("major"))
    place = F.xxhash64("c", "t")
    own = F.when(F.col("root") == F.col("main"), F.col("minor") + F.pmod(place, "major")).otherwise(F.pmod(place, "minor")).cast("int")
    rows = prefix.join(held, "t").withColumn("own", own)
    cells = F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("minor"), F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1))
    small = rows.where((100 + LEVEL) * (F.col("n") - F.col("at")) >= 2 * LEVEL * F.col("n"))
    one = small.select("t", "c", "root", "n", "at", F.col("own").alias("i"), cells.alias("j"))
    two = rows.select("t", F.col("c").alias("d"), F.col("root").alias("root2"), F.col("n").alias("m"), F.col("at").alias("at2"), cells.alias("i"), F.col("own").alias("j"))
    larger = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("c") < F.col("d")))
    enough = (100 + LEVEL) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at2")) >= LEVEL * (F.col("n") + F.col("m"))
    met = one.join(two, ["t", "i", "j"]).where((F.col("root") != F.col("root2")) & larger & (100 * F.col("n") >= LEVEL * F.col("m")) & enough)
    return met.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key (of its text), n_shingles, component_id, kept."""
    return _components_of(docs, id_col, text_col).drop("component")


def _components_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As :func:`near_duplicates`, and ``component``: its root class, whatever the ids; null for texts without words."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(features(docs), "near-features")
    known = rows.where("n > 0")
    one = F.min(F.struct("key", "doc_id", "n", "sketch", "whole", "bands")).alias("one")
    classes = known.groupBy("c").agg(F.min("doc_id").alias("label"), one).select("c", "label", "one.*")
    classes = materialize(classes.select("c", "label", "n", "sketch", "whole", "bands", *_row_key(F.col("doc_id"), F.col("key"))), "near-classes")
    about = classes.select("c", F.struct("n", "sketch", "whole").alias("about"))

    members = classes.select("c", F.explode("bands").alias("v"))
    sizes = members.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(members.join(sizes, "v"), "near-buckets")
    met = members.groupBy("c").agg(F.sum("size").alias("met"))
    # One row a class has its set; copies of a text are dealt apart, by their own ids.
    texts = docs.select(*_row_key(F.col("doc_id"), _text_key(F.col("text"))), "text").dropDuplicates(["ka", "kb"])
    sets = materialize(full_sets(texts.join(classes.join(met, "c", "left_semi").select("ka", "kb", "c"), ["ka", "kb"])), "near-sets")

    centers = members.join(met, "c").groupBy("v").agg(F.max(F.struct("met", "c"))["c"].alias("d"))
    stars = members.select("v", "c").join(centers, "v").where("c != d").select("c", "d").distinct()
    stars = stars.join(about, "c").join(about.withColumnsRenamed({"c": "d", "about": "other"}), "d").where(likely("about", "other")).select("c", "d")
    edges = materialize(confirm(stars, sets), "near-edges")
    labels = components(edges)

    # Buckets that hold classes of several components.
    rest = members.join(labels, "c", "left").select("v", "c", F.coalesce("root", "c").alias("root"))
    open_ = rest.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("v")
    rest = materialize(rest.join(open_, "v", "left_semi").select("c", "root").distinct().join(classes.select("c", "n"), "c"), "near-rest")
    if not rest.isEmpty():
        pairs = across(prefixes(rest, sets)).join(about, "c").join(about.withColumnsRenamed({"c": "d", "about": "other"}), "d").where(likely("about", "other"))
        more = materialize(confirm(pairs.select("c", "d"), sets), "near-more")
        if not more.isEmpty():
            labels = extended(labels, more)

    named = classes.select("c", "label").join(labels, "c")
    least = named.groupBy("root").agg(F.min("label").alias("least"))
    named = named.join(least, "root").select("c", "root", "least")
    final = classes.select("c", "label").join(named, "c", "left").select("c", F.coalesce("least", "label").alias("component_id"), F.coalesce("root", "c").alias("component"))
    joined = known.select("doc_id", "key", "n", "c").join(final, "c").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "component")
    none = F.lit(None).cast(joined.schema["component"].dataType)
    alone = rows.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("component"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of a component the least by id (nulls last) and key; rows equal in id and text are one document.

    What stays is decided on names alone; whole rows are dealt once, repeated ones after they have become one in their task.
    """
    found = _components_of(docs, id_col, text_col)
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    decided = found.groupBy("component", alone.alias("alone")).agg(least).select(*_row_key(F.col("least.doc_id"), F.col("least.key")))
    decided = materialize(decided, "near-kept")
    whole = docs.select(F.struct(*docs.columns).alias("row"), *_row_key(F.col(id_col), _text_key(F.col(text_col).cast("string"))))
    return whole.dropDuplicates(["ka", "kb"]).join(decided, ["ka", "kb"], "left_semi").select("row.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("key")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id != b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES = {"op5_near_dedup": OP5_SQL}
