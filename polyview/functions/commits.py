"""Numbered commits: small files that are made whole, once, by name, and order what they name without a clock."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Commits:
    """Entries below ``base`` in order of their numbers, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.base}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def delete(self, place: str) -> None:
        self._fs.delete(self._path(f"{self.base}/{place}"), True)

    def entries(self) -> list[dict]:
        names = [n for n in self.names("commits") if n.endswith(".json")]
        if not names:
            return []
        text = self.spark.read.text([f"{self.base}/commits/{n}" for n in names], wholetext=True)
        return sorted((json.loads(r.value) for r in text.collect()), key=lambda c: c["version"])

    def add(self, entry: dict) -> int:
        """Give an entry the next free number: of two writers one takes it and the other the one after.  A file is moved to its name when it is whole."""
        version = max((c["version"] for c in self.entries()), default=-1) + 1
        while True:
            ready, final = self._path(f"{self.base}/pending/{uuid.uuid4().hex}"), self._path(f"{self.base}/commits/{version:012d}.json")
            out = self._fs.create(ready, False)
            out.write(bytearray(json.dumps({"version": version, **entry}).encode()))
            out.close()
            self._fs.mkdirs(final.getParent())
            try:
                if not self._fs.exists(final) and self._fs.rename(ready, final):
                    return version
            except Py4JJavaError:
                if not self._fs.exists(final):
                    raise
            self._fs.delete(ready, False)
            version += 1
