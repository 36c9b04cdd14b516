"""Small metadata files and folders through Hadoop's file system, so that any store that Spark reads will do."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """JSON resources and folders under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def path(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def _fs(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, *names: str) -> bool:
        fs, p = self._fs(self.path(*names))
        return fs.exists(p)

    def write(self, value: dict | list, *names: str) -> None:
        """Writes beside the old file, then renames: readers see either version whole."""
        fs, p = self._fs(self.path(*names))
        _, part = self._fs(f"{self.path(*names)}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        try:
            out.write(bytearray(json.dumps(value, indent=1, default=str), "utf-8"))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(part, p):
            raise OSError(f"cannot write {p}")

    def read(self, *names: str) -> dict | list:
        fs, p = self._fs(self.path(*names))
        stream = fs.open(p)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def names(self, *folder: str) -> list[str]:
        fs, p = self._fs(self.path(*folder))
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, *names: str) -> None:
        fs, p = self._fs(self.path(*names))
        fs.delete(p, True)
