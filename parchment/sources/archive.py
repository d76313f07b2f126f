"""Lines of JSON-lines members of zip archives as a Spark data source, ``spark.read.format("parchment_jsonl")``.

Each member is a partition, inflated as it streams out of the store by range reads: no archive and no member is ever held whole.
"""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..cluster import ship
from . import files

SCHEMA = "file string, member string, at long, value string"
_ARROW = pa.schema([("file", pa.string()), ("member", pa.string()), ("at", pa.int64()), ("value", pa.string())])
#: A batch of lines is passed on when it has so many code points, or so many lines.
HELD, LINES = 1 << 22, 8192


def chosen(names: list[str]) -> str:
    """The member of an archive that holds the predictions."""
    for wanted in ("prediction.jsonl.gz", "prediction.jsonl"):
        if wanted in names:
            return wanted
    found = next((n for n in names if _lines_of(n)), None)
    if found is None:
        raise ValueError("the archive has no .jsonl or .jsonl.gz member")
    return found


def _lines_of(name: str) -> bool:
    return name.endswith((".jsonl", ".jsonl.gz"))


@dataclass
class Member(InputPartition):
    path: str
    name: str


#: What a broken archive or member raises, by whichever layer meets it.
BROKEN = (zipfile.BadZipFile, gzip.BadGzipFile, zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, RuntimeError)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, members: str):
        if members not in ("one", "all"):
            raise ValueError(f"members is one or all, not {members}")
        self.path, self.members = path, members

    def _archives(self) -> list[str]:
        """The archive at the path, or those of the folder there, in order of their names."""
        uri = "://" in self.path
        store, at = fs.FileSystem.from_uri(self.path) if uri else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [self.path]
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".zip"))
        head = self.path[: -len(at)] if uri and at and self.path.endswith(at) else ""
        return [head + f for f in found]

    def partitions(self) -> list[Member]:
        """One for each member that is read; only the archives' directories are looked at."""
        out = []
        for path in self._archives():
            try:
                with files.opened(path) as raw, zipfile.ZipFile(raw) as archive:
                    names = [n for n in archive.namelist() if _lines_of(n)] if self.members == "all" else []
                    out += [Member(path, n) for n in (names or [chosen(archive.namelist())])]
            except (*BROKEN, ValueError, OSError) as e:
                raise ValueError(f"{path}: not an archive that can be read: {e}") from e
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        first = size = 0
        try:
            with files.opened(partition.path) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as inner:
                stream = gzip.open(inner) if partition.name.endswith(".gz") else inner
                for line in io.TextIOWrapper(stream, "utf-8"):
                    held.append(line.removesuffix("\n"))
                    size += len(line)
                    if size >= HELD or len(held) >= LINES:
                        yield self._batch(partition, first, held)
                        first, held, size = first + len(held), [], 0
        except (*BROKEN, OSError) as e:
            raise ValueError(f"{partition.path}: member {partition.name} is broken at line {first + len(held) + 1}: {e}") from e
        if held:
            yield self._batch(partition, first, held)

    def _batch(self, p: Member, first: int, held: list[str]) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([p.path] * n), pa.array([p.name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], schema=_ARROW)


class ArchiveSource(DataSource):
    """Options: path (an archive, or a folder of them), members: ``one`` (that of the predictions, the default) or ``all``."""

    @classmethod
    def name(cls) -> str:
        return "parchment_jsonl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        if "path" not in self.options:
            raise ValueError("give a path")
        return ArchiveReader(self.options["path"], self.options.get("members", "one"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ArchiveSource)


def read_archive(spark: SparkSession, path: str, members: str = "one") -> DataFrame:
    """(file, member, at, value) of the lines of members, at from 0; a missing member or a broken archive ends the job with its name and reason."""
    register(spark)
    return spark.read.format("parchment_jsonl").option("members", members).load(path)
