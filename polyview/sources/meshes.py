"""STL meshes as rows of facets, binary or text, long files split over tasks.

A file is binary if its size is that of the facets its header counts, or else if it holds whole records, no ``facet`` near its start,
and only finite coordinates below 1e9 (a header that counts wrong loses to the file).  Otherwise it must be text: ``solid``, whole facets, ``endsolid``.
What is neither, torn, or without facets is refused whole; nothing of it counts as a mesh.

A task reads a range of bytes.  A facet belongs to the range in which it begins, so a task reads on behind its range until its last facet ends, and
skips a facet that began before.  Coordinates are 32-bit floats in both forms.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from polyview.sources.ranges import RANGE, dealt, listed, locate

#: The binary layout, and the size beyond which a coordinate is no geometry.
RECORD = np.dtype([("normal", "<f4", 3), ("v", "<f4", (3, 3)), ("attr", "<u2")])
HEADER, LIMIT = 84, 1e9
CORNERS = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]
_NUMBER = rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_VERTEX = rb"vertex\s+" + rb"\s+".join([rb"(" + _NUMBER + rb")"] * 3) + rb"\s+"
_FACET = re.compile(rb"facet\s+normal\s+\S+\s+\S+\s+\S+\s+outer\s+loop\s+" + _VERTEX * 3 + rb"endloop\s+endfacet(?=\s)", re.I)
_BEGIN = re.compile(rb"(?<![^\s])facet\s+normal\s", re.I)
_BETWEEN = re.compile(rb"\s*(?:endsolid[^\n]*(?:\n\s*|\Z)(?:solid[^\n]*\n\s*)?)?", re.I)
_LAST = re.compile(rb"endsolid[^\n]*\s*\Z", re.I)
_END = re.compile(rb"\s*endsolid[^\n]*\s*\Z", re.I)
_BLOCK = 1 << 16
SCHEMA = "path string, kind string, at long, " + ", ".join(f"{c} double" for c in CORNERS) + ", error string"


def _batch(path: str, kind: str | None, at: np.ndarray, corners: np.ndarray, error: str | None = None) -> pa.RecordBatch:
    n = max(len(at), 1 if error else 0)
    blank = np.ones(n, bool) if error else None
    values = np.zeros((n, 9)) if error else corners.reshape(n, 9)
    columns = [pa.array([path] * n), pa.array([kind] * n, pa.string()), pa.array(np.zeros(n, np.int64) if error else at, mask=blank)]
    columns += [pa.array(np.ascontiguousarray(values[:, k]), mask=blank) for k in range(9)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([error] * n, pa.string())], names=["path", "kind", "at", *CORNERS, "error"])


def sensible(v: np.ndarray) -> bool:
    return bool(np.isfinite(v).all() and np.abs(v).max(initial=0) < LIMIT)


def kind_of(size: int, head: bytes) -> str:
    """honest, counted (by size, against the header) or text, from a file's size and its first 532 bytes."""
    if size >= HEADER:
        (declared,) = struct.unpack_from("<I", head, 80)
        if size == HEADER + 50 * declared:
            return "honest"
        if (size - HEADER) % 50 == 0 and size > HEADER and b"facet" not in head:
            return "counted"
    return "text"


def _binary(f: pa.NativeFile, path: str, size: int, start: int, stop: int, counted: bool) -> Iterator[pa.RecordBatch]:
    n = (size - HEADER) // 50
    if n == 0:
        yield _batch(path, "binary", np.empty(0), np.empty(0), "no facets")
        return
    if counted:  # its facets count only if all of them are geometry, so each task looks at the whole file
        for k in range(0, n, _BLOCK):
            f.seek(HEADER + 50 * k)
            if not sensible(np.frombuffer(f.read(50 * min(_BLOCK, n - k)), RECORD)["v"]):
                yield _batch(path, "binary", np.empty(0), np.empty(0), "not geometry")
                return
    first, last = (max(0, -(-(x - HEADER) // 50)) for x in (start, stop))
    for k in range(first, min(last, n), _BLOCK):
        count = min(_BLOCK, min(last, n) - k)
        f.seek(HEADER + 50 * k)
        v = np.frombuffer(f.read(50 * count), RECORD)["v"].astype(np.float64)
        yield _batch(path, "binary", HEADER + 50 * np.arange(k, k + count), v)


def text_facets(data: bytes, base: int, start: int, stop: int, tail: bytes) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Offsets and corners of the facets that begin in [start, stop), and where a facet or the end is torn (None: nowhere).

    ``data`` holds the file from byte ``base``; ``tail`` is the file's end.
    """
    at, corners = [], []
    m = _BEGIN.search(data, max(start - base, 0))
    place = m.start() if m else len(data)
    if start == 0:
        opening = re.match(rb"\s*solid[^\n]*\n\s*", data, re.I)
        if not opening or not re.match(rb"facet|endsolid", data[opening.end() : opening.end() + 8], re.I):
            return np.empty(0), np.empty((0, 9)), 0
        place = opening.end()
    while base + place < stop and place < len(data):
        m = _FACET.match(data, place)
        if not m:
            if _END.match(data, place):
                break
            return np.array(at, np.int64), np.array(corners, np.float32).reshape(-1, 9), base + place
        at.append(base + place)
        corners.append([float(x) for x in m.groups()])
        place = _BETWEEN.match(data, m.end()).end()
    if not _LAST.search(tail):
        return np.array(at, np.int64), np.array(corners, np.float32).reshape(-1, 9), base + len(data)
    with np.errstate(over="ignore"):
        return np.array(at, np.int64), np.array(corners, np.float64).astype(np.float32).reshape(-1, 9), None


def _text(f: pa.NativeFile, path: str, size: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
    base, upto = max(0, start - 1), stop
    f.seek(base)
    data = f.read(upto - base)
    while upto < size:  # until the last facet that began in the range has ended
        more = f.read(min(_BLOCK, size - upto))
        data, upto = data + more, upto + len(more)
        begun = [m.start() for m in _BEGIN.finditer(data, max(0, len(data) - len(more) - 4096))]
        if any(base + b >= stop for b in begun) or upto - stop > 1 << 20:
            break
    f.seek(max(0, size - _BLOCK))
    at, corners, torn = text_facets(data, base, start, stop, f.read())
    if torn is None and len(corners) and not sensible(corners):
        torn = int(at[~(np.isfinite(corners).all(axis=1) & (np.abs(corners) < LIMIT).all(axis=1))][0])
    if torn is not None:
        yield _batch(path, "text", np.empty(0), np.empty(0), f"torn at byte {torn}")
    elif len(at):
        yield _batch(path, "text", at, corners.astype(np.float64))


class StlSource(DataSource):
    """``spark.read.format("stl").option("range", bytes).load(path)``: a row a facet, or a row with ``error`` where a range is refused."""

    @classmethod
    def name(cls) -> str:
        return "stl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _StlReader(self.options["path"], int(self.options.get("range", RANGE)))


class _StlReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return dealt(listed(self.path, ".stl"), self.width)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = locate(self.path)
        for path, size, start, stop in partition.value:
            with system.open_input_file(path) as f:
                kind = kind_of(size, f.read(532))
                if kind == "text":
                    yield from _text(f, path, size, start, stop)
                else:
                    yield from _binary(f, path, size, start, stop, kind == "counted")


def read_meshes(spark: SparkSession, path: str, width: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Facets (path, kind, at, corners) of the meshes below a folder, and (path, error) of the files that are refused.

    ``at`` is the byte where a facet begins, which orders the facets of a file.  A text without a single facet is refused too.
    """
    spark.dataSource.register(StlSource)
    rows = spark.read.format("stl").option("range", width).load(path)
    bad = rows.filter("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
    files = spark.createDataFrame([(p,) for p, _ in listed(path, ".stl")], "path string")
    seen = rows.select("path").distinct()
    empty = files.join(seen, "path", "left_anti").select("path", F.lit("no facets").alias("error"))
    refused = bad.unionByName(empty)
    return rows.drop("error").filter("at IS NOT NULL").join(refused.select("path"), "path", "left_anti"), refused


def parse_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Facets of ASCII meshes held in a column: key, at, corners; a text that is torn, or no mesh, gives none."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ats, all_corners = [], [np.empty(0, np.int64)], [np.empty((0, 9))]
            for k, body in enumerate(batch.column(1).to_pylist()):
                data = (body or "").encode()
                at, corners, torn = text_facets(data, 0, 0, len(data), data[-_BLOCK:])
                if torn is None and sensible(corners):
                    rows += [k] * len(at)
                    ats.append(at)
                    all_corners.append(corners.astype(np.float64))
            v = np.concatenate(all_corners)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate(ats)), *[pa.array(np.ascontiguousarray(v[:, k])) for k in range(9)]], names=[key, "at", *CORNERS])

    kind = texts.select(key).schema[0].dataType.simpleString()
    return texts.select(key, text).mapInArrow(parse, f"{key} {kind}, at long, " + ", ".join(f"{c} double" for c in CORNERS))
