"""CD audio: raw sectors to stereo samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import errors as E
from ..constants import LEAD_IN, RAW_SECTOR, SAMPLES_PER_SECTOR


def total_samples(length_sectors: Column) -> Column:
    return length_sectors * SAMPLES_PER_SECTOR


def audio_error(layout_kind: Column, number: Column, mode: Column) -> Column:
    """Error for a track that is not audio, else null."""
    text = F.concat(F.lit("non-audio track "), number.cast("string"), F.lit(" (kind = "), layout_kind, F.lit(", mode = "), mode, F.lit(")"))
    return E.invalid_format(F.when(layout_kind != "Audio", text))


def _samples(byte_swap: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("raw").to_pylist()
            ok = np.array([x is not None and len(x) == RAW_SECTOR for x in raw], bool)
            data = np.frombuffer(b"".join(x for x, k in zip(raw, ok, strict=True) if k), np.uint8)
            words = data.view(">u2" if byte_swap else "<u2").reshape(-1, 2).astype(np.int64)
            packed = words[:, 0] | (words[:, 1] << 16)
            off = np.concatenate([[0], np.cumsum(ok * SAMPLES_PER_SECTOR)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(packed), mask=pa.array(~ok))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "number", "sector")), lists, b.column("error")], ["path", "number", "sector", "samples", "error"])

    return run


def sector_samples(rows: DataFrame, byte_swap: bool = False) -> DataFrame:
    """(path, number, sector, raw, error) with ``raw`` unpacked: 588 numbers left | right << 16, unsigned 16-bit halves."""
    schema = f"path string, number bigint, sector bigint, samples array<bigint>, error {E.TYPE}"
    return rows.select("path", F.col("number").cast("bigint").alias("number"), "sector", "raw", "error").mapInArrow(_samples(byte_swap), schema)


def track_samples(sectors: DataFrame, layout: DataFrame, byte_swap: bool = False) -> DataFrame:
    """Samples of the layout's audio tracks, a row a sector, by absolute sector.

    ``sectors`` has (path, sector, raw), counted from the end of the lead-in.  A track
    that is not audio, or that reaches into the lead-in, is one row with an error; a
    sector that the image lacks ends its track with an error row.
    """
    tracks = layout.where("error is null").drop("error")
    err = F.coalesce(
        audio_error(F.col("kind"), F.col("number"), F.col("mode")),
        E.invalid_format(F.when((F.col("absolute_offset") < LEAD_IN) & (F.col("length_sectors") > 0), F.lit("PCM read requested a sector inside the lead-in region"))),
    )
    tracks = tracks.withColumn("error", err)
    bad = tracks.where("error is not null").select("path", "number", F.lit(None).cast("bigint").alias("sector"), F.lit(None).cast("array<bigint>").alias("samples"), "error")
    ends = F.col("absolute_offset") + F.col("length_sectors") - 1
    good = tracks.where("error is null and length_sectors > 0").select("path", "number", F.explode(F.sequence(F.col("absolute_offset"), ends)).alias("sector"))
    rows = good.join(sectors.select("path", (F.col("sector") + LEAD_IN).alias("sector"), "raw"), ["path", "sector"], "left")
    whole = F.length("raw") == RAW_SECTOR
    lost = rows.where(~F.coalesce(whole, F.lit(False))).groupBy("path", "number").agg(F.min("sector").alias("lost"))
    rows = rows.join(lost, ["path", "number"], "left").where("lost is null or sector <= lost")
    rows = rows.withColumn("error", F.when(F.col("sector") == F.col("lost"), E.error("Io", "failed to fill whole buffer")))
    return sector_samples(rows, byte_swap).unionByName(bad)


def joined_sectors(sectors: DataFrame, files: DataFrame) -> DataFrame:
    """Sectors (path, sector, raw) of whole discs whose sheets name several images.

    ``sectors`` has (path, sector, raw) of the images; ``files`` names them in order: (path, file_no, image, size_bytes).
    An image's sectors follow those of the images before it, as in the disc's layout.
    """
    before = Window.partitionBy("path").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.floor(F.col("size_bytes") / RAW_SECTOR)).over(before), F.lit(0))
    placed = files.select(F.col("path").alias("disc"), F.col("image").alias("path"), start.alias("start"))
    return sectors.join(placed, "path").select(F.col("disc").alias("path"), (F.col("start") + F.col("sector")).cast("bigint").alias("sector"), "raw")


def channels(samples: DataFrame) -> DataFrame:
    """A row a stereo sample: path, number, sector, sample, left, right (signed 16 bits)."""
    rows = samples.where("error is null").select("path", "number", "sector", F.posexplode("samples").alias("sample", "packed"))
    signed = lambda x: F.when(x >= 32768, x - 65536).otherwise(x)
    return rows.select("path", "number", "sector", "sample", signed(F.col("packed") % 65536).alias("left"), signed(F.floor(F.col("packed") / 65536)).alias("right"))
