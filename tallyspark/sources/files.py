"""Small files on any file system that Spark knows."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """Reads, replaces, lists and deletes small files below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> Any:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: Any) -> None:
        """Writes beside the file and moves it there. A file that is there goes first, so this is for files with one writer and no readers yet."""
        self._write_new(name, value)
        to = self._path(name)
        if self.fs.exists(to):
            self.fs.delete(to, False)
        self.fs.rename(self._path(f"{name}.new"), to)

    def _write_new(self, name: str, value: Any) -> None:
        new = self._path(f"{name}.new")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def versions(self, name: str) -> list[int]:
        """The numbers of the files name-<number>.json, ascending."""
        own = [n.removeprefix(f"{name}-").removesuffix(".json") for n in self.names("") if n.startswith(f"{name}-") and n.endswith(".json")]
        return sorted(int(n) for n in own if n.isdigit())

    def latest(self, name: str) -> Any:
        """What was last given to `advance`; None if nothing was."""
        found = self.versions(name)
        return self.read(f"{name}-{found[-1]}.json") if found else None

    def advance(self, name: str, value: Any) -> None:
        """Writes the next version of a small record. Its file gets its name by one rename to a name that
        is not taken, so readers see the version before or this one, also if the writer is lost at any point."""
        found = self.versions(name)
        number = found[-1] + 1 if found else 0
        self._write_new(f"{name}-{number}.json", value)
        if not self.fs.rename(self._path(f"{name}-{number}.json.new"), self._path(f"{name}-{number}.json")):
            raise RuntimeError(f"{name} was changed by another writer")
        # a reader may still be at the version before
        for old in found[:-1]:
            self.delete(f"{name}-{old}.json")

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
