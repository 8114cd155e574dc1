"""Line deduplication by a suffix array over sequences of line ids.

Lines with at least one word are a document's sequence; equal lines have equal ids.

1. Prefix doubling.  Suffixes are ranked by their first line; ranks for 2k lines come
   from those for k: the pair (rank at p, rank at p + k) is counted, the different pairs
   are sorted by range, and a pair's place is its new rank, so ranks keep the order of
   the suffix array.  A rank that only one suffix has is finished and leaves; doubling
   ends when all have left, whatever the length of the longest run.
2. Longest common prefixes.  Suffixes of equal rank at depth k are an interval of the
   suffix array with a common prefix of k lines at least.  From the deepest level down,
   every interval is extended by half as many lines each time: members whose next lines
   have equal ranks move into an inner interval and leave its earliest member behind to
   stand for it.  What remains together is an interval whose common prefix is exactly d
   lines: one node of the tree of longest-common-prefix intervals.
3. Deletion.  A node of ``min_lines`` lines or more is a repeated run; its earliest copy,
   by document id and line, stays, the lines of its other copies go, as do later copies
   of single lines of ``min_words`` words.  If a copy of d lines goes, so do the copies
   that begin inside it, down to ``min_lines`` lines, which is why only that many lines
   need marking at each place.  :func:`repeated_runs` lists the maximal runs.

Scale: lines are hashed to 128 bits once and written; counts are aggregated before they
are shuffled; sorts are over different repeated pairs only; joins have one row a key on
one side, so adaptive execution can split a hot line or interval.  The two loops take as
many rounds as the longest repeated run has binary digits, over rows that repeat at that
depth only.  Each round is written to the shared folder.

Defined results: a null text stays null and an empty one empty, with no lines;
lines without a word are kept and ignored; rows equal in id and text are the same
document and get the same result; rows of one id and different texts are separate
documents, in order of a hash; null ids come first; other columns are
ignored; an empty table gives an empty result.  A text's length has no limit but that
of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import materialize, table

MIN_LINES, MIN_WORDS = 2, 50
WORD = r"[^\x20\x09-\x0D]"
#: A line with a word: only \n ends a line, and what stands before the first word is passed over once.
WORDED = r"(?dm)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*"


def document_key(id_: Column, text: Column) -> Column:
    """128-bit fingerprint of a document's id and text."""
    return F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(F.lit(17), id_, text).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """A row a line with a word: id, key, p (its number among such lines), a and b (hashes), long."""
    worded = F.regexp_extract_all("text", F.lit(WORDED), F.lit(0))
    rows = docs.select("id", document_key(F.col("id"), F.col("text")).alias("key"), F.posexplode(worded).alias("p", "x"))
    x = F.col("x")
    long = F.when(F.octet_length(x) >= 2 * MIN_WORDS - 1, F.regexp_count(x, F.lit(WORD + "+")) >= MIN_WORDS).otherwise(False)
    return rows.select("id", "key", "p", F.xxhash64(x).alias("a"), F.xxhash64(F.lit(23), x).alias("b"), long.alias("long"))


def _position() -> Column:
    return F.struct("id", "key", "p")


def ranked(rows: DataFrame, cols: list[str], tag: str, *others: str) -> DataFrame | None:
    """Rows whose ``cols`` occur at more than one position, with rank, first (the earliest position) and size; None if there are none."""
    groups = rows.groupBy(*cols).agg(F.min(_position()).alias("first"), F.max(_position()).alias("last"), F.count("*").alias("size")).where("first < last").drop("last")
    groups = groups.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id())
    groups = materialize(groups, f"{tag}-groups")
    if groups.isEmpty():
        return None
    found = rows.join(groups, cols).select("id", "key", "p", "rank", "first", "size", *others)
    return materialize(found if "here" in cols else found.distinct(), tag)  # repeated rows are one document


def suffix_ranks(lines: DataFrame, depth: int | None = None) -> list[DataFrame]:
    """The repeated suffixes' ranks at depths 1, 2, 4, ... until none is left (or to ``depth``); ``here`` is the rank one level above."""
    levels, now = [], ranked(lines, ["a", "b"], "lines-1", "long")
    while now is not None:
        levels.append(now)
        k = 1 << (len(levels) - 1)
        if k == depth:
            break
        at = Window.partitionBy("key").orderBy("p").rangeBetween(k, k)
        pairs = now.select("id", "key", "p", F.col("rank").alias("here"), F.first("rank").over(at).alias("next")).where("next is not null")
        now = ranked(pairs, ["here", "next"], f"lines-{2 * k}", "here")
    return levels


def _node(first: str, depth: Column) -> Column:
    """A node's name: its earliest member and its depth."""
    return F.struct(F.col(f"{first}.key").alias("key"), F.col(f"{first}.p").alias("p"), depth.alias("d"))


def intervals(levels: list[DataFrame], least: int = 0) -> DataFrame:
    """Nodes of the longest-common-prefix tree by their members: id, key, p, g (node), d (lines in common), n (suffixes stood for).

    A node's members are suffixes that reach no deeper node, and the earliest member of each node below it.
    Nodes of levels before ``least`` are left out.
    """
    state = None
    for s in reversed(range(len(levels))):
        if state is not None:
            after = levels[s].select(F.col("key").alias("tkey"), F.col("p").alias("tp"), "rank")
            seen = materialize(state.join(after, (F.col("key") == F.col("tkey")) & (F.col("p") + F.col("d") == F.col("tp")), "left").drop("tkey", "tp"), "lines-seen")
            met = seen.where("rank is not null").groupBy("g", "rank").agg(F.min(_position()).alias("first"), F.sum("n").alias("n"), F.count("*").alias("size"), F.min("d").alias("d")).where("size > 1")
            names = met.select(F.col("g").alias("mg"), F.col("rank").alias("mrank"), _node("first", F.col("d") + (1 << s)).alias("h"))
            inner = seen.join(names, (F.col("g") == F.col("mg")) & (F.col("rank") == F.col("mrank")), "left")
            moved = inner.select("id", "key", "p", F.coalesce("h", "g").alias("g"), F.when(F.col("h").isNull(), F.col("d")).otherwise(F.col("d") + (1 << s)).alias("d"), "n")
            state = moved.unionByName(met.select("first.*", "g", "d", "n"))
        if s >= least:
            here = levels[s].select("id", "key", "p", "rank", "first", F.lit(1).cast("long").alias("n"))
            if s + 1 < len(levels):
                here = here.join(levels[s + 1].select("key", "p"), ["key", "p"], "left_anti").select(*here.columns)
                # The earliest member of a group at the next level stands for it here.
                stands = levels[s + 1].where(F.col("first") == _position()).select("key", "p", F.col("size").alias("n"))
                here = here.unionByName(levels[s].drop("size").join(stands, ["key", "p"]).select(*here.columns))
            here = here.select("id", "key", "p", _node("first", F.lit(1 << s)).alias("g"), F.lit(1 << s).alias("d"), "n")
            state = here if state is None else state.unionByName(here)
    return state


def _nodes(docs: DataFrame, min_lines: int) -> tuple[DataFrame, DataFrame] | None:
    """Repeated lines, and the members of nodes of ``min_lines`` or more with the nodes' earliest members and copies; None without repeats."""
    levels = suffix_ranks(materialize(line_table(docs), "lines"))
    if not levels:
        return None
    nodes = intervals(levels, min(max(min_lines, 1).bit_length(), len(levels)) - 1).where(F.col("d") >= min_lines)
    nodes = materialize(nodes, "lines-nodes")
    about = nodes.groupBy("g").agg(F.min(_position()).alias("first"), F.sum("n").alias("copies"), F.count("*").alias("members")).where("members > 1")
    return levels[0], nodes.join(about.withColumnRenamed("g", "ag").drop("members"), F.col("g") == F.col("ag")).drop("ag")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Maximal repeated runs: length (lines), copies, and id and p (number among the lines with a word) of the earliest copy.

    A run is maximal if its copies do not all follow the same line and are not all followed by the same line.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _nodes(docs, min_lines)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"length int, copies bigint, id {docs.schema['id'].dataType.simpleString()}, p int")
    nodes = found[1]
    runs = materialize(nodes.groupBy("g").agg(F.min("d").alias("length"), F.min("copies").alias("copies"), F.min("first").alias("first")).drop("g"), "lines-maximal")
    # If one line precedes all copies, the run that begins with it has as many and the earliest of them begins one line before.
    wider = runs.select(F.col("first.key").alias("wkey"), (F.col("first.p") + 1).alias("wp"), (F.col("length") - 1).alias("wlength"), F.col("copies").alias("wcopies"))
    same = (F.col("first.key") == F.col("wkey")) & (F.col("first.p") == F.col("wp")) & (F.col("length") == F.col("wlength")) & (F.col("copies") == F.col("wcopies"))
    return runs.join(wider, same, "left_anti").select("length", "copies", "first.id", "first.p")


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per document with repeats: key, deleted (ascending numbers among its lines with a word), longest_run."""
    found = _nodes(docs, min_lines)
    if found is None:
        return docs.sparkSession.createDataFrame([], "key struct<a:bigint,b:bigint>, deleted array<int>, longest_run bigint")
    lines, nodes = found
    later = F.col("first") < _position()
    copies = nodes.select("key", "d", F.when(later, F.sequence(F.col("p"), F.col("p") + min_lines - 1)).alias("gone"))
    alone = lines.where(later & F.col("long")).select("key", F.lit(0).alias("d"), F.array("p").alias("gone"))
    return copies.unionByName(alone).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("deleted"), F.max("d").cast("long").alias("longest_run"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, then kept_text, n_lines, n_deleted, n_runs (maximal deleted runs) and longest_run.

    ``longest_run`` is the length of the longest repeated run, of ``min_lines`` or more, that the text has a copy of (else 0).
    """
    gone = deleted_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), min_lines).withColumnRenamed("key", "dkey")
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    joined = whole.withColumn("key", document_key(F.col(f"row.`{id_col}`"), text)).join(gone, F.col("key") == F.col("dkey"), "left")
    # Each step is used more than once by the next, so that Spark computes it once a row and not once an element.
    some = F.size("deleted") > 0
    split = joined.select("row", "deleted", "longest_run", text.alias("text"), F.when(some, _lines(text)).alias("lines"))
    places = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
    split = split.select("row", "deleted", "longest_run", "text", "lines", places.alias("places"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("deleted", lambda p: F.get("places", p)))
    begins = F.filter("deleted", lambda p, i: (i == 0) | (F.get("deleted", i - 1) != p - 1))
    return split.select(
        "row",
        F.when(some, F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).otherwise(F.col("text")).alias("kept_text"),
        F.coalesce(F.regexp_count("text", F.lit(WORDED)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(some, F.size("deleted")).otherwise(0).cast("long").alias("n_deleted"),
        F.when(some, F.size(begins)).otherwise(0).cast("long").alias("n_runs"),
        F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


# From the definition: every maximal match of lines between two places (equal lines at one distance), whatever its length.
OP6_SQL = r"""
WITH l0 AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM l0),
l2 AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
       FROM l1 WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
m AS (SELECT a.doc_id AS da, a.p AS pa, b.doc_id AS db, b.p AS pb, b.w AS w,
        a.p - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.p - a.p ORDER BY a.p) AS island
      FROM l2 a JOIN l2 b ON a.x = b.x AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.p < b.p))),
n AS (SELECT *, count(*) OVER (PARTITION BY da, db, pb - pa, island) AS length FROM m),
g AS (SELECT DISTINCT db AS doc_id, pb AS p FROM n WHERE length >= 2 OR w >= 50),
t AS (SELECT doc_id, max(length) AS longest FROM (SELECT da AS doc_id, length FROM n UNION ALL SELECT db, length FROM n) WHERE length >= 2 GROUP BY doc_id),
k AS (SELECT l2.doc_id, l2.i, l2.p, g.p IS NOT NULL AS gone FROM l2 LEFT JOIN g ON l2.doc_id = g.doc_id AND l2.p = g.p),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM k),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted, count(*) FILTER (WHERE opens) AS n_runs FROM r GROUP BY doc_id),
e AS (SELECT l1.doc_id, string_agg(l1.x, chr(10) ORDER BY l1.i) AS kept FROM l1 LEFT JOIN k ON l1.doc_id = k.doc_id AND l1.i = k.i
      WHERE NOT coalesce(gone, false) GROUP BY l1.doc_id)
SELECT l0.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest, 0)::BIGINT AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM l0 LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {"op6_line_dedup": OP6_SQL}
