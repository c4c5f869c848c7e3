"""Folders of stored tables, on whatever file system holds them."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path."""

    def __init__(self, spark: SparkSession, path: str, parent: Folder | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._kind = parent._kind if parent else spark._jvm.org.apache.hadoop.fs.Path
        self._at = self._kind(self.path)
        self._fs = parent._fs if parent else self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def of(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}", self)

    def exists(self) -> bool:
        return self._fs.exists(self._at)

    def names(self) -> list[str]:
        """What it holds, in order; nothing if it isn't there."""
        if not self.exists():
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at))

    def make(self) -> None:
        self._fs.mkdirs(self._at)

    def delete(self) -> None:
        self._fs.delete(self._at, True)

    def move(self, to: Folder) -> None:
        """Rename to a place that is free; an error if the file system doesn't do it."""
        if not self._fs.rename(self._at, to._at):
            raise OSError(f"{self.path} couldn't be renamed to {to.path}")
