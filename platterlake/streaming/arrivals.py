"""Images and cue sheets as they arrive in a folder, with Structured Streaming.

Each file is judged by itself, so the queries keep no state and need no watermark; the
stream's checkpoint remembers which files have been seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import file_hashes
from ..operators import images

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_images(spark: SparkSession, folder: str, pattern: str = "*", hashes: str = "Crc32", files_per_trigger: int = 100) -> DataFrame:
    """(path, length, format, error, hashes) of every new file; for files that fit one value."""
    rows = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    fmt, err = images.detect_format(F.col("content"))
    return rows.select("path", "length", fmt.alias("format"), err.alias("error"), file_hashes(F.col("content"), hashes).alias("hashes"))


def arriving_sheets(spark: SparkSession, folder: str, pattern: str = "*.cue", files_per_trigger: int = 1000) -> DataFrame:
    """(path, text) of every new cue sheet, for ``foreachBatch`` with the operators of :mod:`platterlake.operators.cue`."""
    rows = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
