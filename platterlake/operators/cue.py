"""Cue sheets as tables: files, tracks, indexes, compatibility, conversion.

A sheet is a row ``(path, text)`` and is read within its row by :mod:`.sheet_text`, so
nothing is dealt or sorted.  Errors are rows ``(path, error)``: one bad sheet leaves the
others alone.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid_format
from . import sheet_text
from .sheet_text import BYTE_OFFSET, NO_FILE, NO_OUTPUT, NO_TRACKS, OPEN_QUOTE, TOO_MANY, UNFIXABLE

__all__ = ["BYTE_OFFSET", "NO_FILE", "NO_OUTPUT", "NO_TRACKS", "OPEN_QUOTE", "TOO_MANY", "UNFIXABLE", "Parsed", "compatibility", "convert", "parse", "standardize"]


class Parsed(NamedTuple):
    """files(path, file_no, filename, file_type), tracks(path, file_no, ordinal, number, mode),
    indexes(path, ordinal, p, number, minutes, seconds, frames, sector), errors(path, error)."""

    files: DataFrame
    tracks: DataFrame
    indexes: DataFrame
    errors: DataFrame


def parse(sheets: DataFrame, strip_bom: bool = False) -> Parsed:
    """Files, tracks and indexes of standard and extended sheets.

    An index belongs to the last track if that track is of the current file, else it is
    left out, as are lines of any other kind and indexes that are malformed.
    """
    text = F.regexp_replace("text", "\\A\ufeff", "") if strip_bom else F.col("text")
    table = lambda each, **fields: sheets.select("path", F.inline(sheet_text.rows(each, fields, text)))
    return Parsed(
        table(sheet_text.files, file_no="bigint", filename="string", file_type="string"),
        table(sheet_text.tracks, file_no="bigint", ordinal="bigint", number="bigint", mode="string"),
        table(sheet_text.indexes, ordinal="bigint", p="int", number="bigint", minutes="bigint", seconds="bigint", frames="bigint", sector="bigint"),
        table(sheet_text.errors, message="string").select("path", invalid_format(F.col("message")).alias("error")),
    )


def compatibility(sheets: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What of the extended dialect each sheet uses, a row a sheet, with is_standard, can_auto_fix and summary."""
    flags = ["has_datafile", "has_audiofile", "has_extra_directives", "has_comments"]
    fields = {"disc_type_header": "string", "numbers": "array<bigint>", "modes": "array<string>", **dict.fromkeys(flags, "boolean"), "offset": "boolean"}
    out = sheets.select("path", *keep, F.inline(sheet_text.rows(_compatibility, fields, "text")))
    out = out.select(
        "path",
        *keep,
        "disc_type_header",
        F.zip_with("numbers", "modes", lambda n, m: F.struct(n.alias("number"), m.alias("mode"))).alias("cdwin_track_modes"),
        *flags,
        F.when(F.col("offset"), UNFIXABLE).alias("unfixable_reason"),
    )
    used = F.col("disc_type_header").isNotNull() | (F.size("cdwin_track_modes") > 0)
    for c in flags:
        used = used | F.col(c)
    summary = F.concat_ws(
        ", ",
        F.concat("disc_type_header", F.lit(" header")),
        F.when(F.size("cdwin_track_modes") > 0, F.concat(F.size("cdwin_track_modes").cast("string"), F.lit(" CDRWin track mode(s)"))),
        F.when(F.col("has_datafile"), "DATAFILE"),
        F.when(F.col("has_audiofile"), "AUDIOFILE"),
        F.when(F.col("has_extra_directives"), "extra directives"),
        F.when(F.col("has_comments"), "comments"),
    )
    return out.select("*", (~used).alias("is_standard"), (used & F.col("unfixable_reason").isNull()).alias("can_auto_fix"), summary.alias("summary"))


def _compatibility(text: str | None) -> list[tuple]:
    return [sheet_text.compatibility(text)]


def _convert(text: str | None) -> list[tuple]:
    return [sheet_text.convert(text)]


def _standardize(text: str | None) -> list[tuple]:
    return [sheet_text.standardize(text)]


def _rewritten(sheets: DataFrame, each) -> DataFrame:
    rows = sheets.select("path", F.inline(sheet_text.rows(each, {"made": "string", "problem": "string"}, "text")))
    return rows.select("path", F.col("made").alias("text"), invalid_format(F.col("problem")).alias("error"))


def convert(sheets: DataFrame) -> DataFrame:
    """Rows (path, text, error): each sheet rewritten in the standard dialect.

    A FILE, DATAFILE or AUDIOFILE line lets go the tracks before it: before its own
    output for FILE and the sheet's end, after it for the others.
    """
    return _rewritten(sheets, _convert)


def standardize(sheets: DataFrame) -> DataFrame:
    """Rows (path, text, error): standard sheets as they are, others converted, unfixable ones an error."""
    return _rewritten(sheets, _standardize)
