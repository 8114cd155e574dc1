"""Cue sheets, tags, titles and images made from the synthetic tables, as inputs of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHD_MAGIC, CD_SYNC, ISO_SECTOR, RAW_SECTOR
from ..functions.timecode import sectors_to_msf


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(data: Column, n: int) -> Column:
    """Bytes with zeros up to ``n``."""
    return F.rpad(data, F.lit(n), F.lit(b"\x00"))


def le32(n: Column) -> Column:
    """Four bytes, little-endian."""
    pairs = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*(F.substring(pairs, i, 2) for i in (7, 5, 3, 1))))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order and line number: path, n, frames (at least 1), mode; dealt by path, once for all that follows."""
    path = F.concat(F.lit("o"), F.coalesce(F.col("l_orderkey").cast("string"), F.lit("null")))
    rows = table(spark, sf_dir, "lineitem").select(path.alias("path"), F.col("l_linenumber").cast("bigint").alias("n"), "l_quantity", "l_returnflag").repartition("path")
    rows = rows.groupBy("path", "n").agg(F.sum("l_quantity").cast("bigint").alias("frames"), F.min("l_returnflag").alias("flag"))
    mode = F.when(F.col("flag") == "A", "MODE1_RAW").when(F.col("flag") == "N", "AUDIO").otherwise("MODE2_RAW")
    return rows.select("path", "n", "frames", mode.alias("mode"))


def _sheets(rows: DataFrame, head: Column, line, tail: Column | None = None) -> DataFrame:
    """One text a path: head, then a line a track in order; ``line`` gets the track and the frames before it."""
    told = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "frames", "mode"))).alias("t"))
    before = lambda i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, x: s + x["frames"])
    body = F.array_join(F.transform("t", lambda x, i: line(x, before(i))), "")
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s + x["frames"])
    return told.select("path", F.concat(head, body, *([tail] if tail is not None else [])).alias("text"), total.alias("total"))


def standard_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, total): one file a sheet, INDEX 01 where the frames before end, a little clutter."""
    mode = lambda x: F.when(x["mode"] == "AUDIO", "AUDIO").otherwise(F.concat(F.substring(x["mode"], 1, 5), F.lit("/2352")))
    line = lambda x, at: F.concat(F.format_string("  TRACK %02d ", x["n"]), mode(x), F.lit("\r\n    PREGAP 00:02:00\r\n    INDEX 01 "), sectors_to_msf(at), F.lit("\r\n"))
    return _sheets(tracks(spark, sf_dir), F.concat(F.lit('REM made\r\n\r\nFILE "'), "path", F.lit('.bin" BINARY\r\n')), line)


def extended_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, total): the extended dialect, one DATAFILE of a length for each track, all in one file."""
    line = lambda x, at: F.concat(F.lit("// track\nTRACK "), x["mode"], F.lit("\nNO COPY\nDATAFILE "), F.col("path"), F.lit(".bin "), sectors_to_msf(x["frames"]), F.lit(" // length\n"))
    return _sheets(tracks(spark, sf_dir), F.lit("CD_ROM_XA\n"), line)


def sizes(sheets: DataFrame) -> DataFrame:
    return sheets.select("path", F.concat("path", F.lit(".bin")).alias("filename"), (F.col("total") * RAW_SECTOR).alias("size_bytes"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, tag, text): container tags of the tracks, one of each path without FRAMES."""
    text = F.concat(F.format_string("TRACK:%d TYPE:", "n"), "mode", F.format_string(" SUBTYPE:NONE FRAMES:%d PREGAP:0", "frames"))
    entry = lambda seq, tag, text: F.struct(seq.cast("bigint").alias("seq"), F.lit(tag).alias("tag"), text.alias("text"))
    good, bad, other = entry(100 - F.col("n"), "CHT2", text), entry(F.lit(1000), "CHTR", F.lit("TRACK:9 TYPE:AUDIO")), entry(F.lit(1000), "GDDD", F.lit("TRACK:8 FRAMES:5"))
    more = F.when(F.col("n") == 1, F.array(bad, other)).otherwise(F.array().cast("array<struct<seq:bigint,tag:string,text:string>>"))
    return tracks(spark, sf_dir).select("path", F.inline(F.concat(F.array(good), more)))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, base, number, name): a disc tag between name and brand; every fifth size has a word for a number."""
    p = table(spark, sf_dir, "part")
    number = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("bigint"))
    tag = F.coalesce(number.cast("string"), F.lit("Two"))
    return p.select(F.col("p_partkey").alias("idx"), number.alias("number"), F.concat("p_name", F.lit(" (Disc "), tag, F.lit(") ("), "p_brand", F.lit(")")).alias("name"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): beginnings of each kind of image, by part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 6
    name = F.col("p_name").cast("binary")
    content = (
        F.when(k == 0, F.concat(F.lit(CHD_MAGIC), pad(name, 64)))
        .when(k == 1, F.concat(F.lit(CD_SYNC), pad(name, 64)))
        .when(k == 2, F.concat(F.lit(b"rem x\nfile "), name, F.lit(b" binary\n track 01 audio")))
        .when(k == 3, F.concat(pad(name, 16 * ISO_SECTOR), F.lit(b"\x01CD001\x01")))
        .when(k == 4, F.substring(name, 1, 5))
        .otherwise(F.concat(F.lit(b"\x01\x02"), pad(name, 64)))
    )
    return p.select(F.col("p_partkey").alias("path"), content.alias("content"))


def volume_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, sector, raw) of a small volume a nation: descriptor, root directory, one file in two sectors, raw or plain."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    name = F.col("n_name").cast("binary")

    def record(at: Column, size: Column, id_: Column, id_length: Column) -> Column:
        """A directory record: length, extended length, place and size (both ways round), date, flags, name."""
        whole = F.concat(F.lit(b"\x00"), le32(at), F.lit(bytes(4)), le32(size), F.lit(bytes(4 + 7 + 1 + 2 + 4)), F.unhex(F.lpad(F.hex(id_length), 2, "0")), id_)
        return F.concat(F.unhex(F.lpad(F.hex(33 + id_length), 2, "0")), whole)

    file_name = F.concat(F.lit("f"), key.cast("string"), F.lit(".txt;1")).cast("binary")
    size = F.lit(ISO_SECTOR) + key
    root = F.concat(
        record(F.lit(18), F.lit(ISO_SECTOR), F.lit(b"\x00"), F.lit(1)), record(F.lit(18), F.lit(ISO_SECTOR), F.lit(b"\x01"), F.lit(1)), record(F.lit(20), size, file_name, F.length(file_name).cast("int"))
    )
    field = lambda c, width: F.rpad(c, F.lit(width), F.lit(b" "))
    pvd = F.concat(F.lit(b"\x01CD001\x01\x00"), field(F.lit(b"PLAYER"), 32), field(name, 32), F.lit(bytes(8)), le32(1000 + key), F.lit(bytes(72)), record(F.lit(18), F.lit(ISO_SECTOR), F.lit(b"\x00"), F.lit(1)))
    content = F.rpad(name, F.lit(2 * ISO_SECTOR), name)
    data = F.array(
        F.struct(F.lit(16).alias("sector"), pad(pvd, ISO_SECTOR).alias("d")),
        F.struct(F.lit(18).alias("sector"), pad(root, ISO_SECTOR).alias("d")),
        F.struct(F.lit(20).alias("sector"), F.substring(content, 1, ISO_SECTOR).alias("d")),
        F.struct(F.lit(21).alias("sector"), F.substring(content, ISO_SECTOR + 1, ISO_SECTOR).alias("d")),
    )
    rows = n.select(F.col("n_name").alias("path"), key.alias("key"), F.inline(data))
    raw = F.concat(F.lit(CD_SYNC), F.lit(bytes(12)), "d", F.lit(bytes(280)))
    return rows.select("path", F.col("sector").cast("bigint").alias("sector"), F.when(F.col("key") % 2 == 0, F.col("d")).otherwise(raw).alias("raw"))


def audio_sectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sectors (path, sector, raw) and layout of one audio track a supplier, whose first sample is made of its key."""
    s = table(spark, sf_dir, "supplier")
    first = F.col("s_suppkey") * 65536 * 3 % 4294967296 + F.col("s_nationkey")
    sectors = s.select(F.col("s_name").alias("path"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("s_nationkey") % 4).cast("bigint"))).alias("sector"), pad(le32(first), RAW_SECTOR).alias("raw"))
    layout = s.select(
        F.col("s_name").alias("path"),
        F.lit(1).cast("bigint").alias("ordinal"),
        F.lit(1).cast("bigint").alias("number"),
        F.lit(150).cast("bigint").alias("absolute_offset"),
        (F.col("s_nationkey") % 4 + 1).cast("bigint").alias("length_sectors"),
        F.when(F.col("s_nationkey") % 5 == 0, "Data").otherwise("Audio").alias("kind"),
        F.lit("AUDIO").alias("mode"),
        F.lit(None).cast("struct<kind:string,message:string>").alias("error"),
    )
    return sectors, layout
