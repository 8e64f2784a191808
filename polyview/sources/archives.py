"""Zip archives read by ranges: directories from the files' ends, members and files as streams.  No archive is ever held whole."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from polyview.operators import maintenance as M
from polyview.sources.ranges import RANGE, Ranges, listed, opened

CHUNK = 1 << 20
ENTRIES = "zip string, place long, name string, size long, packed long, crc long, method int, is_dir boolean, error string"
#: What can go wrong with a file that is no zip, a torn one, or one that has gone.
FAULTS = (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError, ValueError, zlib.error)


class ZipSource(DataSource):
    """``spark.read.format("zipdir").load(path)``: a row an entry of every zip below a folder; a zip that cannot be read is a row with ``error``."""

    @classmethod
    def name(cls) -> str:
        return "zipdir"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options["path"])


class _ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        """A zip's directory is read by one task; zips share tasks by number, as only their ends are read."""
        files = [(p, n, 0, n) for p, n in listed(self.path, ".zip")]
        return [Ranges(files[k : k + 100]) for k in range(0, len(files), 100)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        for path, *_ in partition.value:
            try:
                with opened(scheme + path) as f, zipfile.ZipFile(f) as z:
                    infos = z.infolist()
            except FAULTS as e:
                yield path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            for place, i in enumerate(infos):
                yield path, place, i.filename, i.file_size, i.compress_size, i.CRC, i.compress_type, i.is_dir(), None


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zipdir").load(path)


def crc_of(stream, length: int | None = None) -> tuple[int, int]:
    """Checksum and size of a stream, or of its next ``length`` bytes."""
    crc = size = 0
    while length is None or size < length:
        block = stream.read(CHUNK if length is None else min(CHUNK, length - size))
        if not block:
            break
        crc, size = zlib.crc32(block, crc), size + len(block)
    return crc, size


def member_faults(members: DataFrame) -> DataFrame:
    """zip, name, fault of members (zip, name) read through: null if a member's bytes have the size and checksum its archive states."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, group in b.groupby("zip", sort=False):
                for name in group["name"]:
                    try:
                        with opened(path) as f, zipfile.ZipFile(f) as z, z.open(name) as m:
                            crc_of(m)  # a wrong checksum raises at the end
                        out.append((path, name, None))
                    except (KeyError, *FAULTS) as e:
                        out.append((path, name, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["zip", "name", "fault"])

    return members.select("zip", "name").repartition("zip", "name").mapInPandas(check, "zip string, name string, fault string")


def _times(m: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= m[k]
        v, k = v >> 1, k + 1
    return out


def crc_joined(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings one behind the other, from theirs and the second's length.

    A zero byte acts on the checksum as a matrix over bits; its power by ``length`` comes from repeated squaring.
    """
    step = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    power = length * 8
    while power:
        if power & 1:
            first = _times(step, first)
        power >>= 1
        step = [_times(step, x) for x in step]
    return first ^ second


def file_checksums(files: DataFrame, width: int = RANGE) -> DataFrame:
    """path, size, crc of files (path, size), long ones in ranges over several tasks; crc is null for a file that is gone or shorter by now."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with opened(path) as f:
                        f.seek(start)
                        crc, size = crc_of(f, length)
                except OSError:
                    crc, size = None, length
                crcs.append(crc if size == length else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(crcs, pa.int64())], names=["path", "start", "length", "crc"])

    def join(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts, crc = parts.sort_values("start"), 0
        for x, n in zip(parts["crc"], parts["length"]):
            crc = None if crc is None or pd.isna(x) else crc_joined(crc, int(x), int(n))
        return pd.DataFrame({"path": [key[0]], "size": [int(parts["length"].sum())], "crc": pd.array([crc], "Int64")})

    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(width).cast("long")))
    cut = files.select("path", "size").distinct().select("path", start.alias("start"), "size").select("path", "start", F.least(F.lit(width), F.col("size") - F.col("start")).cast("long").alias("length"))
    return cut.repartition("path", "start").mapInArrow(ranges, "path string, start long, length long, crc long").groupBy("path").applyInPandas(join, "path string, size long, crc long")


def content_elsewhere(spark: SparkSession, root: str) -> DataFrame:
    """(zip, elsewhere) of every readable zip below a local folder: whether its content lies there already, in whatever layout.

    Only files that a sampled entry meets by base name and size are read for their checksum.
    """
    root = root.rstrip("/")
    relative = lambda c: F.concat(F.lit("./"), F.substring(c, len(root) + 2, 1 << 20))  # noqa: E731  (the root is a folder too)
    rows = scan_archives(spark, root).filter("error IS NULL AND NOT is_dir").withColumn("zip", relative(F.col("zip")))
    entries = rows.select("zip", F.regexp_replace("zip", "/[^/]*$", "").alias("parent"), "place", "name", "size", "crc")
    files = spark.createDataFrame([(f".{p[len(root) :]}", n) for p, n in listed(root, "") if not p.lower().endswith(".zip")], "path string, size long")
    sampled = M.spread_sample(entries.filter(~M.is_junk(F.col("name"))), "zip", "place", 5).select(M.base_name(F.col("name")).alias("base"), "size").distinct()
    asked = files.withColumn("base", M.base_name(F.col("path"))).join(sampled, ["base", "size"], "left_semi").select(F.concat(F.lit(root), F.substring("path", 2, 1 << 20)).alias("path"), "size")
    crcs = file_checksums(asked).select(relative(F.col("path")).alias("path"), "crc")
    return M.content_elsewhere(entries, files.join(crcs, "path", "left"))
