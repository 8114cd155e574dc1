"""Small images, containers and sheets written to the shared folder, one of each a nation, for queries that read them back.

Tasks write the files and may run again: a file's name and bytes depend on its row alone.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..constants import RAW_SECTOR
from ..sources import images as sources

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder where ``spark.checkpoint.dir`` says; on a local master without the setting, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="platterlake-files-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        named = _OWN[0]
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}/files-{uuid.uuid4().hex}"


def _content(kind: str, name: str, key: int) -> dict[str, bytes]:
    """Files of a nation: the one that is read, and others that go with it."""
    text = (name * 2100).encode()[: 2049 + key]
    plain = fixtures.volume({f"F{key}.TXT": text}, "PLAYER", name)
    if kind == "image":
        return {f"{key}.img": plain if key % 2 == 0 else fixtures.raw_image(plain)}
    if kind == "container":
        raw = fixtures.raw_image(plain)
        units = [raw[i : i + RAW_SECTOR] + bytes(96) for i in range(0, len(raw), RAW_SECTOR)]
        tags = [(b"CHT2", b"TRACK:1 TYPE:MODE2_RAW SUBTYPE:NONE FRAMES:%d" % len(units)), (b"CHT2", b"TRACK:2 TYPE:AUDIO SUBTYPE:NONE FRAMES:%d" % (key + 1))]
        return {f"{key}.chd": fixtures.container(units, tags if key % 5 else tags[:0])}
    sheet = f'FILE "{key}.bin" BINARY\n  TRACK 01 AUDIO\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    INDEX 01 00:00:02\n'
    return {f"{key}.cue": sheet.encode(), f"{key}.bin": bytes((key + 3) * RAW_SECTOR)}


def written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The folder in which the files of this kind now are."""
    to = folder(spark)
    scheme, inner = to.split(":", 1) if ":" in to else ("", to)
    inner = "/" + inner.lstrip("/") if scheme in ("", "file") else to

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = sources.opened(inner)
        system.create_dir(top, recursive=True)
        for f in frames:
            for name, key in zip(f.n_name, f.n_nationkey, strict=True):
                for file, data in _content(kind, name, int(key)).items():
                    with system.open_output_stream(f"{top}/{file}") as out:
                        out.write(data)
            yield pd.DataFrame({"n": [len(f)]})

    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", "n_nationkey").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    sources.register(spark)
    return inner


def read(spark: SparkSession, sf_dir: str, kind: str, source: str, **options: str) -> DataFrame:
    """Rows of a source over the files, with ``key``, the nation's, for the path."""
    rows = spark.read.format(source).options(path=written(spark, sf_dir, kind), **options).load()
    return rows.withColumn("path", key(F.col("path")))


def key(path: Column) -> Column:
    """A file's number, as text."""
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1)
