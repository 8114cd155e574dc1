"""Disc images as bytes: format detection, sectors, volume descriptors, directories, files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors as E
from ..constants import CD_SYNC, CHD, CHD_MAGIC, CUE, FORMAT_EXTENSIONS, FORMAT_NAMES, ISO, ISO_SECTOR, MAX_FILE, MODE1_OFFSET, MODE2_FORM1_OFFSET, RAW, RAW_SECTOR, VOLUME_SECTOR
from ..functions.binary import read_padded, slice_bytes, unsigned_le

#: Bytes from an image's start that decide its format.
HEAD = VOLUME_SECTOR * ISO_SECTOR + 6
MISSING_SIGNATURE = "Missing CD001 signature in PVD"
UNKNOWN_FORMAT = "Not a recognized disc format"


def looks_like_cue(head: Column) -> Column:
    """Whether the first 512 bytes are text that names a file and a track."""
    text = F.decode(slice_bytes(head, 0, 512), "ISO-8859-1")
    upper = F.upper(text)
    return (F.length(text) > 0) & ~text.rlike(r"[\x00-\x08\x0E-\x19\x1B-\x1F]") & upper.contains("FILE ") & upper.contains("TRACK ")


def detect_format(head: Column, length: Column | None = None) -> tuple[Column, Column]:
    """(format, error) from an image's first ``HEAD`` bytes; ``length`` is the image's, if ``head`` is not all of it."""
    length = F.length(head) if length is None else length
    found = (
        F.when(slice_bytes(head, 0, 8) == F.lit(CHD_MAGIC), CHD)
        .when(slice_bytes(head, 0, 12) == F.lit(CD_SYNC), RAW)
        .when(looks_like_cue(head), CUE)
        .when(slice_bytes(head, VOLUME_SECTOR * ISO_SECTOR + 1, 5) == F.lit(b"CD001"), ISO)
    )
    small = length < 12
    err = F.when(small, E.too_small(12, length)).when(found.isNull(), E.invalid_format(UNKNOWN_FORMAT))
    return F.when(~small, found), err


def _names(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def format_name(fmt: Column) -> Column:
    return _names(FORMAT_NAMES)[fmt]


def format_extension(fmt: Column) -> Column:
    return _names(FORMAT_EXTENSIONS)[fmt]


def user_data(raw: Column, offset: int = MODE2_FORM1_OFFSET) -> Column:
    """2048 bytes of user data of a sector row: all of a 2048-byte sector, from ``offset`` of a raw one; null if short."""
    data = F.when(F.length(raw) == RAW_SECTOR, slice_bytes(raw, offset, ISO_SECTOR)).otherwise(raw)
    return F.when(F.length(data) == ISO_SECTOR, data)


def sector_data(content: Column, sector: Column, fmt: Column, offset: int = MODE2_FORM1_OFFSET) -> tuple[Column, Column]:
    """(user data, error) of a numbered sector of a whole image."""
    at = F.when(fmt == ISO, sector * ISO_SECTOR).when(fmt == RAW, sector * RAW_SECTOR + offset)
    data = F.when((at >= 0) & (at + ISO_SECTOR <= F.length(content)), slice_bytes(content, at, ISO_SECTOR))
    err = F.when(at.isNull(), E.unsupported("Cannot read sectors directly from CUE/CHD format")).when(
        data.isNull(), E.corrupted_header(F.concat(F.lit("Sector "), sector.cast("string"), F.lit(" is beyond end of image")))
    )
    return data, err


def sector_data_mode1(content: Column, sector: Column, fmt: Column) -> tuple[Column, Column]:
    return sector_data(content, sector, fmt, MODE1_OFFSET)


def split_sectors(images: DataFrame, fmt: str = "format") -> DataFrame:
    """Rows (path, sector, raw) of whole images (path, content, format); an incomplete last sector is left out.

    For images that fit one value; large ones are read by the ``sectors`` source.
    """
    size = F.when(F.col(fmt) == RAW, RAW_SECTOR).otherwise(ISO_SECTOR)
    n = F.floor(F.length("content") / size)
    rows = images.where(F.col(fmt).isin(ISO, RAW) & (n > 0)).select("path", "content", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("sector"))
    return rows.select("path", "sector", slice_bytes(F.col("content"), F.col("sector") * F.col("size"), F.col("size")).alias("raw"))


def volume(data: Column) -> tuple[Column, Column]:
    """(descriptor, error) of the user data of sector 16."""
    fields = F.struct(
        read_padded(slice_bytes(data, 8, 32)).alias("system_identifier"),
        read_padded(slice_bytes(data, 40, 32)).alias("volume_identifier"),
        unsigned_le(data, 80, 4).alias("volume_space_size"),
        unsigned_le(data, 158, 4).alias("root_dir_extent_lba"),
        unsigned_le(data, 166, 4).alias("root_dir_data_length"),
    )
    kind = F.hex(slice_bytes(data, 0, 1))
    err = (
        F.when(data.isNull(), E.corrupted_header(f"Sector {VOLUME_SECTOR} is beyond end of image"))
        .when(kind != "01", E.invalid_format(F.concat(F.lit("Expected PVD type 0x01, got 0x"), kind)))
        .when(slice_bytes(data, 1, 5) != F.lit(b"CD001"), E.invalid_format(MISSING_SIGNATURE))
    )
    return F.when(err.isNull(), fields), err


def volumes(sectors: DataFrame, offset: int = MODE2_FORM1_OFFSET) -> DataFrame:
    """Rows (path, pvd, error) from sector rows (path, sector, raw)."""
    here = sectors.where(F.col("sector") == VOLUME_SECTOR).select("path", user_data(F.col("raw"), offset).alias("d"))
    rows = sectors.select("path").distinct().join(here, "path", "left")
    pvd, err = volume(F.col("d"))
    return rows.select("path", pvd.alias("pvd"), err.alias("error"))


def parse_record(record: Column) -> Column:
    """Struct of one directory record, or null: too short, or its name overruns it."""
    n, id_len = unsigned_le(record, 0, 1), unsigned_le(record, 32, 1)
    name = slice_bytes(record, 33, id_len)
    text = F.when(name == F.lit(b"\x00"), ".").when(name == F.lit(b"\x01"), "..").otherwise(F.make_valid_utf8(name.cast("string")))
    good = (F.length(record) >= 33) & (n >= 33) & (33 + id_len <= n) & (33 + id_len <= F.length(record))
    return F.when(
        good,
        F.struct(unsigned_le(record, 2, 4).alias("extent_lba"), unsigned_le(record, 10, 4).alias("data_length"), unsigned_le(record, 25, 1).alias("file_flags"), text.alias("file_identifier")),
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts directory sectors into records: each record's first byte is its length."""
    for b in batches:
        row, pos, record = [], [], []
        for i, data in enumerate(b.column("data").to_pylist()):
            at = 0
            while data and at < len(data) and data[at] and at + data[at] <= len(data):
                row.append(i)
                pos.append(at)
                record.append(data[at : at + data[at]])
                at += data[at]
        yield pa.RecordBatch.from_arrays(
            [b.column("path").take(pa.array(row, pa.int64())), b.column("sector").take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(record, pa.binary())], ["path", "sector", "pos", "record"]
        )


def directory(sectors: DataFrame, offset: int = MODE2_FORM1_OFFSET) -> DataFrame:
    """Records of the root directories: path, sector, pos, extent_lba, data_length, file_flags, file_identifier."""
    pvd = volumes(sectors, offset).where("error is null").select("path", "pvd.root_dir_extent_lba", "pvd.root_dir_data_length")
    n = F.ceil(F.col("root_dir_data_length") / ISO_SECTOR).cast("bigint")
    wanted = pvd.where("root_dir_data_length > 0").select("path", F.explode(F.sequence(F.col("root_dir_extent_lba"), F.col("root_dir_extent_lba") + n - 1)).alias("sector"))
    data = sectors.join(wanted, ["path", "sector"]).select("path", "sector", user_data(F.col("raw"), offset).alias("data"))
    rows = data.mapInArrow(_chain, "path string, sector bigint, pos int, record binary").withColumn("r", parse_record(F.col("record")))
    return rows.where("r is not null").select("path", "sector", "pos", "r.*")


def find_files(sectors: DataFrame, wanted: DataFrame, offset: int = MODE2_FORM1_OFFSET) -> DataFrame:
    """For (path, filename) rows: the first matching root record as ``record``, or an error.

    Names match without regard to case, up to the first semicolon of the record's.
    """
    same = F.upper(F.substring_index("file_identifier", ";", 1)).alias("target")
    found = directory(sectors, offset).select("path", same, F.struct("sector", "pos").alias("at"), F.struct("extent_lba", "data_length", "file_flags", "file_identifier").alias("r"))
    first = found.groupBy("path", "target").agg(F.min_by("r", "at").alias("record"))
    asked = wanted.select("path", "filename", F.upper("filename").alias("target"))
    rows = asked.join(first, ["path", "target"], "left").join(volumes(sectors, offset).select("path", F.col("error").alias("volume_error")), "path", "left")
    missing = E.other(F.concat(F.lit("File '"), "filename", F.lit("' not found in root directory")))
    err = F.coalesce("volume_error", F.when(F.col("record").isNull(), missing).when(F.col("record.data_length") > MAX_FILE, E.corrupted_header("ISO 9660 file size exceeds safety limit")))
    return rows.select("path", "filename", "record", err.alias("error"))


def _join_parts(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("i")
    row = parts.slice(0, 1)
    data = parts.column("data").to_pylist()
    whole = b"".join(data)[: row.column("data_length")[0].as_py()] if None not in data else None
    return pa.table({"path": row.column("path"), "filename": row.column("filename"), "content": pa.array([whole], pa.binary())})


def file_contents(sectors: DataFrame, found: DataFrame, offset: int = MODE2_FORM1_OFFSET) -> DataFrame:
    """Rows (path, filename, content, error) for the result of :func:`find_files`.

    A file's sectors are an equi-join; its bytes, at most 256 MiB, are put together in
    one task a file.
    """
    last = F.col("record.extent_lba") + F.ceil(F.col("record.data_length") / ISO_SECTOR).cast("bigint") - 1
    good = found.where("error is null and record.data_length > 0")
    parts = good.select("path", "filename", F.col("record.data_length").alias("data_length"), F.posexplode(F.sequence(F.col("record.extent_lba"), last)).alias("i", "sector"))
    data = sectors.select("path", "sector", user_data(F.col("raw"), offset).alias("data"))
    parts = parts.join(data, ["path", "sector"], "left").select("path", "filename", "data_length", "i", "data")
    whole = parts.groupBy("path", "filename").applyInArrow(_join_parts, "path string, filename string, content binary")
    rows = found.join(whole, ["path", "filename"], "left")
    content = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("record.data_length") == 0, F.lit(b"")).otherwise(F.col("content"))
    err = F.coalesce("error", F.when(content.isNull(), E.corrupted_header(F.concat(F.lit("File '"), "filename", F.lit("' goes beyond the end of the image")))))
    return rows.select("path", "filename", content.alias("content"), err.alias("error"))
