"""Scans of small files: STL measures, embedding matrices, categories, listings.  Long meshes and zips have sources of their own."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from polyview.sources.meshes import RECORD, kind_of, sensible

def read_stl(data: bytes) -> np.ndarray | None:
    """Triangles (n, 3, 3) of a binary STL, or None: size decides; where the header counts wrong, whole records of finite geometry."""
    if len(data) < 84:
        return None
    kind, n = kind_of(len(data), data[:532]), (len(data) - 84) // 50
    if kind == "text" or n == 0:
        return None
    v = np.frombuffer(data, RECORD, n, 84)["v"].astype(np.float64)
    return v if kind == "honest" or sensible(v) else None


def scan_stl(spark: SparkSession, path: str) -> DataFrame:
    """path, n_triangles, extent of each readable mesh below a folder; unreadable ones have nulls."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [read_stl(x) for x in b["content"]]
            yield pd.DataFrame({"path": b["path"], "n_triangles": [None if x is None else len(x) for x in v], "extent": [None if x is None else float((x.max(axis=(0, 1)) - x.min(axis=(0, 1))).max()) for x in v]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][tT][lL]").load(path)
    return files.select("path", "content").mapInPandas(measure, "path string, n_triangles long, extent double")


def scan_npy(spark: SparkSession, path: str) -> DataFrame:
    """stem, view, embedding rows of saved (views, dim) matrices; torn files give no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    m = np.load(io.BytesIO(data), allow_pickle=False)
                except (ValueError, EOFError, OSError):
                    continue
                out += [(p.rsplit("/", 1)[-1].removesuffix(".npy"), i, row.astype(float).tolist()) for i, row in enumerate(np.atleast_2d(m))]
            yield pd.DataFrame(out, columns=["stem", "view", "embedding"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(rows, "stem string, view int, embedding array<double>")


def categories(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank stripped lines of one file, in order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "category"))
    return lines.select("line", F.regexp_replace("category", r"^\s+|\s+$", "").alias("category")).filter("category <> ''")


class ListingSource(DataSource):
    """A folder listing by Python, for names that Spark's file sources skip (``_x``, empty files)."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "rel string, size long, mtime_ns long"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


class _ListingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import os

        return [InputPartition(e.name) for e in sorted(os.scandir(self.path), key=lambda e: e.name)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import os

        top = os.path.join(self.path, partition.value)
        found = [top] if os.path.isfile(top) else [os.path.join(d, f) for d, _, names in os.walk(top) for f in names]
        for f in sorted(found):
            s = os.stat(f)
            yield os.path.relpath(f, self.path), s.st_size, s.st_mtime_ns
