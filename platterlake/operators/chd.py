"""Track metadata of compressed disc images: text tags such as ``TRACK:1 TYPE:AUDIO FRAMES:100``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unsigned

TRACK_TAGS = ("CHTR", "CHT2")


def _field(words: Column, field: str) -> Column:
    return F.substr(F.get(F.filter(words, lambda w: w.startswith(f"{field}:")), F.lit(0)), F.lit(len(field) + 2))


def meta_field(text: Column, field: str) -> Column:
    """Value of the first ``FIELD:value`` word, empty if nothing follows the colon; null if there is none."""
    return _field(F.split(text, r"(?U)\s+"), field)


def is_data(track_type: Column) -> Column:
    return track_type.contains("MODE")


def _entries(meta: DataFrame) -> DataFrame:
    """All track entries; track_number and frames are both null unless both are whole numbers.

    Each step names what the next uses more than once, and ``inline`` keeps conditions
    on its columns above it: a text is split once, however often its fields are used.
    """
    rows = meta.where(F.col("tag").isin(*TRACK_TAGS)).select("path", "seq", F.split(F.regexp_replace("text", "\0+\\z", ""), r"(?U)\s+").alias("words"))
    rows = rows.select("path", "seq", *(_field(F.col("words"), f).alias(f.lower()) for f in ("TRACK", "TYPE", "FRAMES")))
    rows = rows.select("path", "seq", unsigned(F.col("track"), 4294967295).alias("track"), "type", unsigned(F.col("frames"), (1 << 62)).alias("frames"))
    whole = F.col("track").isNotNull() & F.col("frames").isNotNull()
    number, frames = F.when(whole, F.col("track")), F.when(whole, F.col("frames"))
    return rows.select("path", "seq", F.inline(F.array(F.struct(number.alias("track_number"), F.coalesce("type", F.lit("UNKNOWN")).alias("track_type"), frames.alias("frames")))))


def parse_tracks(meta: DataFrame) -> DataFrame:
    """Tracks from rows (path, seq, tag, text): track_number, track_type, frames, start_sector, seq.

    Entries of other tags, or without a whole number of track or frames, are left out.
    Tracks follow by number; each starts where the frames before it end.
    """
    before = Window.partitionBy("path").orderBy("track_number", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = _entries(meta).where("track_number is not null")
    return rows.withColumn("start_sector", F.coalesce(F.sum("frames").over(before), F.lit(0)))


def skipped_tracks(meta: DataFrame) -> DataFrame:
    """Per path: how many track entries :func:`parse_tracks` had to leave out."""
    return _entries(meta).groupBy("path").agg((F.count("*") - F.count("track_number")).alias("skipped"))


def largest_data_track(tracks: DataFrame) -> DataFrame:
    """Per path: the data track of most frames, the last of equals."""
    key = F.struct("frames", "track_number", "seq")
    rows = tracks.where(is_data(F.col("track_type"))).groupBy("path").agg(F.max_by(F.struct("track_number", "track_type", "frames", "start_sector"), key).alias("t"))
    return rows.select("path", "t.*")


def track1_frames(tracks: DataFrame) -> DataFrame:
    """Per path: frames of track 1 (of the first, if there are several)."""
    return tracks.where("track_number = 1").groupBy("path").agg(F.min_by("frames", "seq").alias("frames"))
