"""Small side files, such as annotations and sessions, on the driver's disk or on the file system that a cluster shares."""

from __future__ import annotations

import os
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


class LocalFiles:
    """Files on the driver's disk."""

    def read(self, path: str) -> str | None:
        """The whole text, None without a file."""
        try:
            return Path(path).read_text(encoding="utf-8")
        except FileNotFoundError:
            return None

    def write(self, path: str, text: str) -> None:
        """Through a draft that takes the file's place at once; missing folders are made."""
        draft = Path(f"{path}.tmp")
        draft.parent.mkdir(parents=True, exist_ok=True)
        draft.write_text(text, encoding="utf-8")
        os.replace(draft, path)

    def names(self, folder: str) -> list[str]:
        return sorted(p.name for p in Path(folder).iterdir() if p.is_file()) if Path(folder).is_dir() else []

    def remove(self, path: str) -> None:
        Path(path).unlink(missing_ok=True)


class SharedFiles:
    """The same by Hadoop's client: the scheme of a path says where it is, without one it is in the default file system."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    @contextmanager
    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        # an instance of its own, as its checksums are off: files that other programs wrote have none
        fs = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(where.toUri(), self._conf)
        fs.setVerifyChecksum(False)
        fs.setWriteChecksum(False)
        try:
            yield fs, where
        finally:
            fs.close()

    def read(self, path: str) -> str | None:
        with self._at(path) as (fs, where):
            if not fs.exists(where):
                return None
            stream = fs.open(where)
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
            finally:
                stream.close()

    def write(self, path: str, text: str) -> None:
        draft = f"{path}.tmp"
        with self._at(draft) as (fs, where):
            stream = fs.create(where, True)
            try:
                stream.write(bytearray(text.encode("utf-8")))
            finally:
                stream.close()
            kind = self._jvm.org.apache.hadoop.fs.Options.Rename
            over = self._gateway.new_array(kind, 1)
            over[0] = kind.OVERWRITE
            target = self._jvm.org.apache.hadoop.fs.Path(path)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf).rename(where, target, over)

    def names(self, folder: str) -> list[str]:
        with self._at(folder) as (fs, where):
            return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isFile()) if fs.exists(where) else []

    def remove(self, path: str) -> None:
        with self._at(path) as (fs, where):
            fs.delete(where, False)

    def size(self, path: str) -> int:
        """Bytes of all files under a path."""
        with self._at(path) as (fs, where):
            return fs.getContentSummary(where).getLength()
