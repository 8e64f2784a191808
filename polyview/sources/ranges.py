"""Files read by byte ranges on any file system that Arrow knows (local, S3, GCS, HDFS), for Python data sources."""

from __future__ import annotations

import io
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes of one task: long files are cut, short ones share a task.
RANGE = 32 << 20


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder whose names end so, in any case; one file counts as itself."""
    system, path = locate(uri)
    top = system.get_file_info(path)
    found = [top] if top.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffix))


class _Raw(io.RawIOBase):
    """An Arrow file with the errors of Python's."""

    def __init__(self, file):
        self._file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self._file.tell(), self._file.size())[whence]
        if at < 0:
            raise OSError("a place before the file's start")
        return self._file.seek(at)

    def readinto(self, buffer) -> int:
        return self._file.readinto(buffer)

    def close(self) -> None:
        self._file.close()
        super().close()


def opened(uri: str) -> io.BufferedReader:
    """A file for reading anywhere in it."""
    system, path = locate(uri)
    return io.BufferedReader(_Raw(system.open_input_file(path)), 1 << 16)


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, byte behind the last) of what one task reads."""

    value: list[tuple[str, int, int, int]]


def dealt(files: list[tuple[str, int]], width: int = RANGE) -> list[Ranges]:
    """Files cut into ranges of ``width`` bytes, and ranges gathered to tasks of about as many; an empty file is a range too."""
    out, held, load = [], [], 0
    for path, size in files:
        for start in range(0, max(size, 1), width):
            stop = min(start + width, size)
            held.append((path, size, start, stop))
            load += stop - start
            if load >= width or len(held) >= 1000:
                out.append(Ranges(held))
                held, load = [], 0
    return out + ([Ranges(held)] if held else [])
