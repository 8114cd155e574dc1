"""Cue sheets and file sizes from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDER = r"\A(.*)/[^/]*\z"


def read_sheets(spark: SparkSession, folder: str, pattern: str = "*.cue") -> DataFrame:
    """(path, text) of the sheets under a folder, each file whole."""
    rows = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, filename, size_bytes) of all files under a folder; no content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return rows.select(F.regexp_extract("path", _FOLDER, 1).alias("folder"), F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size_bytes"))


def sizes_for(sheets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, filename, size_bytes): the files beside each sheet, as the layout operators ask for them."""
    beside = sheets.select("path", F.regexp_replace(F.regexp_extract("path", _FOLDER, 1), r"\Afile:/+", "/").alias("f"))
    here = sizes.select(F.regexp_replace("folder", r"\Afile:/+", "/").alias("f"), "filename", "size_bytes")
    return beside.join(here, "f").drop("f")
