"""Small-file access through Hadoop's file systems, so that tables can live in any store Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(self._conf)
        self.root = self.fs.makeQualified(self._path(root)).toString().rstrip("/")

    def at(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path)))

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def read(self, path: str) -> bytes:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """Write a new file whole or not at all; False if the path exists. Renaming never replaces a file here."""
        draft = f"{path}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(draft), False)
        stream.write(data)
        stream.close()
        if self.exists(path) or not self.fs.rename(self._path(draft), self._path(path)):
            self.delete(draft)
            return False
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
