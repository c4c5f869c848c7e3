"""A log that is still written, as a stream: lines appended to files in a folder, through rotation and restarts.

A file is known by its inode and its first line, not by its name, so a renamed file goes on where it was, and a file
that is cut and written anew under its old name is a new one. Offsets are, for each file, the byte after the last whole
line that was seen; the checkpoint keeps them. The folder must be a path that the driver and all executors can open.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads, and that are read in one go.
PART_BYTES, GO_BYTES = 64 << 20, 1 << 20
#: Bytes of a first line that tell files apart.
HEAD = 1024


def local_path(path: str) -> str:
    """A path of this machine or of a mounted folder; ``file:`` may stand before it."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"a log that is still written must be in a folder that can be opened, not {path}")
    return url.path


def identity(path: str) -> str | None:
    """Inode and checksum of the first line; None while there is no whole line, or no file."""
    try:
        with open(path, "rb") as f:
            head = f.readline(HEAD)
            return f"{os.fstat(f.fileno()).st_ino}-{zlib.crc32(head)}" if head.endswith(b"\n") or len(head) == HEAD else None
    except FileNotFoundError:
        return None


def whole_lines(path: str) -> int:
    """The byte after a file's last line end."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at:
            step = min(at, GO_BYTES)
            f.seek(at - step)
            place = f.read(step).rfind(b"\n")
            if place >= 0:
                return at - step + place + 1
            at -= step
    return 0


@dataclass
class Part(InputPartition):
    """The lines that begin in a stretch of a file, which had a name when this was planned."""

    name: str
    file: str
    begin: int
    end: int
    size: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = local_path(options["path"]), options.get("pattern", "*")
        self.at_end = options.get("start", "beginning") == "end"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))

    def files(self) -> dict[str, str]:
        """Names by identity."""
        found = {}
        for name in sorted(os.listdir(self.folder)):
            if fnmatch(name, self.pattern) and not name.startswith((".", "_")):
                file = identity(f"{self.folder}/{name}")
                if file is not None:
                    found.setdefault(file, name)
        return found

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.at_end else {}

    def latestOffset(self) -> dict:
        found = {}
        for file, name in self.files().items():
            try:
                found[file] = whole_lines(f"{self.folder}/{name}")
            except FileNotFoundError:  # rotated away since it was listed
                pass
        return found

    def partitions(self, start: dict, end: dict) -> list[Part]:
        names, parts = self.files(), []
        for file, size in end.items():
            begin = start.get(file, 0)
            if begin < size:
                if file not in names:
                    raise FileNotFoundError(f"a log of {self.folder} was deleted before bytes {begin} to {size} of it were read")
                parts += [Part(names[file], file, at, min(at + self.part_bytes, size), size) for at in range(begin, size, self.part_bytes)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        path = f"{self.folder}/{part.name}"
        f = open(path, "rb") if identity(path) == part.file else open(f"{self.folder}/{self.files()[part.file]}", "rb")
        with f:
            f.seek(part.begin)
            if part.begin:  # a line that began before is another task's
                f.seek(part.begin - 1)
                f.readline()
            at = f.tell()
            while at < part.end:
                lines = f.readlines(min(GO_BYTES, part.end - at))
                own = []
                for line in lines:
                    if at >= part.end:
                        break
                    own.append(line[:-1].decode("utf-8", "replace"))
                    at += len(line)
                yield pa.record_batch([pa.array(own, pa.string())], names=["value"])

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, folder: str, pattern: str = "*", start: str = "beginning", part_bytes: int = PART_BYTES) -> DataFrame:
    """``value``: the whole lines of the folder's files that fit ``pattern``, each once, those there and those to come;
    from ``start="end"`` only lines that are written after the first start."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("logtail").options(path=folder, pattern=pattern, start=start, partbytes=str(part_bytes)).load()
