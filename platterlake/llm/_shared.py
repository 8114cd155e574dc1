"""Helpers that the training-data operators share: tables, shared folders, Arrow blocks.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the
driver and all executors see.  A table written there survives the loss of any
executor and cuts the lineage; nothing here uses ``localCheckpoint``.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to Python while a working table is written.
BATCH = 4 << 20
_OWN: list[str] = []
_SCOPE: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="work")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named Parquet table, only the columns asked for (other columns may clash)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """Folder that the cluster names in ``spark.checkpoint.dir``; a temporary one where it is unset.

    Only a local master may run without the setting: there the driver's disk is
    the executors' disk.  On a cluster a missing setting is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="platterlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables that are materialised inside belong to ``name``, so that :func:`release` can delete them alone."""
    token = _SCOPE.set(name)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def _folder(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_dir(spark), spark.sparkContext.applicationId, *parts])


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH bytes while a table is written: a task holds several of them, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (a folder a value of ``by``) and return the written table."""
    spark = df.sparkSession
    path = _folder(spark, _SCOPE.get(), f"{tag}-{uuid.uuid4().hex}")
    with small_batches(spark):
        df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *names: str) -> None:
    """Delete the materialised tables of the named scopes, or all that this application has made.

    Call it once the results that were built on them have been written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in [_folder(spark, n) for n in names] or [_folder(spark)]:
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at)
            at = to


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the n+1 offsets into them; nulls are empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one message."""
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """Arrays of a message, by their types."""
    sizes, at, out = np.frombuffer(data, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out
