"""Absolute-sector track layouts from cue sheets and from container metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors as E
from ..constants import LEAD_IN
from ..functions import timecode as T
from . import sheet_text

COLUMNS = ["path", "ordinal", "number", "absolute_offset", "length_sectors", "kind", "mode", "error"]


_FIELDS = {"ordinal": "int", "number": "bigint", "absolute_offset": "bigint", "length_sectors": "bigint", "mode": "string", "error_kind": "string", "message": "string"}


def _laid_out(sheets: DataFrame, sizes: DataFrame, text: Column, each) -> DataFrame:
    named = sizes.where("filename is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("filename", F.col("size_bytes").cast("bigint").alias("size")))).alias("sizes"))
    rows = sheets.join(named, "path", "left")
    found = sheet_text.rows(each, _FIELDS, text, F.col("sizes.filename"), F.col("sizes.size"))
    if "error" in sheets.columns:
        given = F.struct(*(F.lit(None).cast(kind).alias(name) for name, kind in list(_FIELDS.items())[:-2]), F.col("error.kind").alias("error_kind"), F.col("error.message").alias("message"))
        found = F.when(F.col("error").isNotNull(), F.array(given)).otherwise(found)
    rows = rows.select("path", F.inline(found))
    good = F.col("error_kind").isNull()
    error = F.when(~good, F.struct(F.col("error_kind").alias("kind"), "message"))
    return rows.select("*", F.when(good, T.classify_mode(F.col("mode"))).alias("kind"), error.alias("error")).select(*COLUMNS)


def cue_layout(sheets: DataFrame, sizes: DataFrame, strip_bom: bool = False) -> DataFrame:
    """A row a track, or one row with an error for a sheet that has no layout.

    ``sheets`` has (path, text), and may have (error); ``sizes`` has (path, filename,
    size_bytes): the sizes of the files that a sheet names.  Within a file a track ends where the next one's INDEX 01
    is, the last at the file's end; the first track of a sheet begins at the lead-in
    plus its own INDEX 01, and each other where the one before it ends.  Each sheet's
    first problem, in order of its files, is its error.
    """
    text = F.regexp_replace("text", "\\A\ufeff", "") if strip_bom else F.col("text")
    return _laid_out(sheets, sizes, text, sheet_text.layout)


def read_layout(sheets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Like :func:`cue_layout`, with extended sheets converted first; what cannot be converted is an error row."""
    return _laid_out(sheets.select("path", "text"), sizes, F.col("text"), sheet_text.read_layout)


def lead_out(layout: DataFrame) -> DataFrame:
    """First sector after the last track, a row a path."""
    return layout.where("error is null").groupBy("path").agg(F.max(F.col("absolute_offset") + F.col("length_sectors")).alias("lead_out"))


def chd_layout(tracks: DataFrame) -> DataFrame:
    """Layout of container tracks (path, track_number, track_type, frames, start_sector); numbers over 255 are errors."""
    over = F.when(F.col("track_number") > 255, F.concat(F.lit("track number "), F.col("track_number").cast("string"), F.lit(" does not fit a layout")))
    place = F.row_number().over(Window.partitionBy("path").orderBy("start_sector", "track_number"))
    return tracks.select(
        "path",
        place.alias("ordinal"),
        F.col("track_number").cast("bigint").alias("number"),
        (F.col("start_sector") + LEAD_IN).alias("absolute_offset"),
        F.col("frames").alias("length_sectors"),
        T.classify_mode(F.col("track_type")).alias("kind"),
        F.col("track_type").alias("mode"),
        E.invalid_format(over).alias("error"),
    )


def read_chd_layout(meta: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """Layout of containers from rows (path, seq, tag, text, error); one that cannot be read, or has no tracks, is an error row.

    A container without any entry has no row in ``meta``; ``containers`` (path) names those too.
    """
    from .chd import parse_tracks

    tracks = chd_layout(parse_tracks(meta.where("error is null")))
    if containers is not None:
        meta = meta.unionByName(containers.select("path"), allowMissingColumns=True)
    broken = meta.groupBy("path").agg(F.first("error", ignorenulls=True).alias("broken"))
    some = tracks.select("path").distinct().withColumn("some", F.lit(True))
    none = E.invalid_format(F.when(F.col("some").isNull(), F.lit("container lists no tracks")))
    bad = broken.join(some, "path", "left").select("path", F.coalesce("broken", none).alias("error")).where("error is not null")
    good = tracks.join(bad.select("path"), "path", "left_anti")
    return good.unionByName(bad, allowMissingColumns=True)
