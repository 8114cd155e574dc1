"""Python data sources for disc images.

``head`` reads an image's first bytes, ``sectors`` its sectors in byte ranges (so that
one large image is read by many tasks), ``chd_info``, ``chd_meta`` and ``chd_sectors``
compressed-hunk containers.  Register them with :func:`register`.  Paths may have any
scheme that pyarrow's file systems know; a plain path is local to every executor.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..constants import RAW_SECTOR
from . import chd as C

#: Bytes of an image in one partition, and of sectors in one Arrow batch.
RANGE, BATCH = 32 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(paths: str) -> list[tuple[str, int]]:
    """Files and sizes of a comma-separated list of files and folders."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            prefix = path.split("://")[0] + "://" if "://" in path else ""
            out += [(prefix + x.path, x.size) for x in system.get_file_info(fs.FileSelector(inner, recursive=True)) if x.is_file]
        elif info.is_file:
            out.append((path, info.size))
        else:
            raise FileNotFoundError(path)
    return sorted(out)


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"]
        self.options = dict(options)

    def partitions(self) -> list[_Part]:
        return [_Part(p, 0, n) for p, n in self.files()]

    #: What filters leave: paths, sectors, and bounds of sectors (None: all).
    only_paths: set[str] | None = None
    only_sectors: set[int] | None = None
    least, end = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows what is read by conditions on path and sector; Spark checks them again."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            values = {value} if isinstance(f, EqualTo) else set(value) if isinstance(f, In) else None
            if column == ("path",) and values is not None:
                self.only_paths = values if self.only_paths is None else self.only_paths & values
            elif column == ("sector",) and values is not None:
                self.only_sectors = values if self.only_sectors is None else self.only_sectors & values
            elif column == ("sector",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.least = max(self.least, value + isinstance(f, GreaterThan))
            elif column == ("sector",) and isinstance(f, (LessThan, LessThanOrEqual)):
                end = value + isinstance(f, LessThanOrEqual)
                self.end = end if self.end is None else min(self.end, end)
            yield f

    def files(self) -> list[tuple[str, int]]:
        return [x for x in listed(self.paths) if self.only_paths is None or x[0] in self.only_paths]

    def ranges(self, sectors: int, step: int) -> Iterator[tuple[int, int]]:
        """What is wanted of an image of so many sectors, in ranges of ``step`` at most."""
        first, end = self.least, sectors if self.end is None else min(self.end, sectors)
        if self.only_sectors is None:
            yield from ((i, min(i + step, end)) for i in range(first, end, step))
            return
        run: list[int] = []
        for i in sorted(x for x in self.only_sectors if x is not None and first <= x < end):
            if run and i == run[1] and i - run[0] < step:
                run[1] = i + 1
                continue
            if run:
                yield run[0], run[1]
            run = [i, i + 1]
        if run:
            yield run[0], run[1]


class _Head(_Reader):
    def read(self, part: _Part) -> Iterator[tuple]:
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            yield (part.path, part.end, f.read(min(part.end, int(self.options.get("bytes", 32774)))))


class _Sectors(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.size = int(options.get("sector_size", RAW_SECTOR))

    def partitions(self) -> list[_Part]:
        step = max(RANGE // self.size, 1)
        return [_Part(p, i, j) for p, n in self.files() for i, j in self.ranges(n // self.size, step)] or [_Part("", 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.first >= part.end:
            return
        system, inner = opened(part.path)
        step = max(BATCH // self.size, 1)
        with system.open_input_file(inner) as f:
            for first in range(part.first, part.end, step):
                n = min(step, part.end - first)
                f.seek(first * self.size)
                data = f.read(n * self.size)
                raw = [data[i * self.size : (i + 1) * self.size] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(raw, pa.binary())], ["path", "sector", "raw"])


class HeadSource(DataSource):
    """(path, length, head); option ``bytes``."""

    @classmethod
    def name(cls) -> str:
        return "head"

    def schema(self) -> str:
        return "path string, length bigint, head binary"

    def reader(self, schema) -> _Reader:
        return _Head(self.options)


class SectorSource(DataSource):
    """(path, sector, raw); option ``sector_size`` (2352). An incomplete last sector is left out."""

    @classmethod
    def name(cls) -> str:
        return "sectors"

    def schema(self) -> str:
        return "path string, sector bigint, raw binary"

    def reader(self, schema) -> _Reader:
        return _Sectors(self.options)


class _ChdInfo(_Reader):
    def read(self, part: _Part) -> Iterator[tuple]:
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            try:
                h = C.read_header(f)
                yield (part.path, h.version, h.hunk_bytes, h.hunks, h.logical_bytes, h.unit_bytes, None)
            except C.ChdError as e:
                yield (part.path, None, None, None, None, None, (e.kind, str(e)))


class _ChdMeta(_Reader):
    def read(self, part: _Part) -> Iterator[tuple]:
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            try:
                for seq, (tag, data) in enumerate(C.read_metadata(f, C.read_header(f))):
                    yield (part.path, seq, tag, data.decode("utf-8", "replace"), None)
            except C.ChdError as e:
                yield (part.path, None, None, None, (e.kind, str(e)))


class _ChdSectors(_Reader):
    def partitions(self) -> list[_Part]:
        """Parts of a container's bytes; which hunks these are is only known where its header is read."""
        return [_Part(p, i, min(i + RANGE, n)) for p, n in self.files() for i in range(0, max(n, 1), RANGE)] or [_Part("", 0, -1)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        """The hunks that a part's share of the bytes stands for; each is read once, for all of its sectors."""
        if part.end < 0:
            return
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            path, sector, raw, held = [], [], [], 0
            try:
                h = C.read_header(f)
            except C.ChdError as e:
                if part.first == 0:  # said once
                    yield self.batch([part.path], [None], [None], (e.kind, str(e)))
                return
            try:
                size, per = max(f.size(), 1), h.hunk_bytes // h.unit_bytes
                first, end = (-(-h.hunks * x // size) for x in (part.first, part.end))
                sectors = -(-h.logical_bytes // h.unit_bytes)
                wanted = sorted({k for i, j in self.ranges(sectors, sectors or 1) for k in range(max(i // per, first), min((j - 1) // per + 1, end))})
                hunks = C.Hunks(f, h) if wanted else None
                for i in wanted:
                    data = hunks.read(i)
                    for k in range(min(per, sectors - i * per)):
                        path.append(part.path)
                        sector.append(i * per + k)
                        raw.append(data[k * h.unit_bytes : k * h.unit_bytes + RAW_SECTOR])
                    held += len(data)
                    if held >= BATCH:
                        yield self.batch(path, sector, raw)
                        path, sector, raw, held = [], [], [], 0
            except C.ChdError as e:
                yield self.batch(path, sector, raw)
                yield self.batch([part.path], [None], [None], (e.kind, str(e)))
                return
            yield self.batch(path, sector, raw)

    @staticmethod
    def batch(path: list, sector: list, raw: list, error: tuple[str, str] | None = None) -> pa.RecordBatch:
        kind = pa.struct([("kind", pa.string()), ("message", pa.string())])
        errors = pa.array([error and {"kind": error[0], "message": error[1]}] * len(path), kind)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(sector, pa.int64()), pa.array(raw, pa.binary()), errors], ["path", "sector", "raw", "error"])


class ChdInfoSource(DataSource):
    """Header fields: (path, version, hunk_size, total_hunks, logical_size, unit_bytes, error)."""

    @classmethod
    def name(cls) -> str:
        return "chd_info"

    def schema(self) -> str:
        return "path string, version bigint, hunk_size bigint, total_hunks bigint, logical_size bigint, unit_bytes bigint, error struct<kind:string,message:string>"

    def reader(self, schema) -> _Reader:
        return _ChdInfo(self.options)


class ChdMetaSource(DataSource):
    """Metadata entries: (path, seq, tag, text, error); a broken container, or list of entries, ends with an error row."""

    @classmethod
    def name(cls) -> str:
        return "chd_meta"

    def schema(self) -> str:
        return "path string, seq bigint, tag string, text string, error struct<kind:string,message:string>"

    def reader(self, schema) -> _Reader:
        return _ChdMeta(self.options)


class ChdSectorSource(DataSource):
    """Raw sectors: (path, sector, raw, error); hunks that cannot be decoded end their part with an error row."""

    @classmethod
    def name(cls) -> str:
        return "chd_sectors"

    def schema(self) -> str:
        return "path string, sector bigint, raw binary, error struct<kind:string,message:string>"

    def reader(self, schema) -> _Reader:
        return _ChdSectors(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to ``spark.read.format``, and let conditions on path and sector reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (HeadSource, SectorSource, ChdInfoSource, ChdMetaSource, ChdSectorSource):
        spark.dataSource.register(source)
