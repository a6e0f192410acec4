"""Lines of growing files by byte position: a data source for batches and for streams.

``format("appended_lines")`` gives (file, at, value), ``at`` being the place of
a line's first byte.  As a stream it reads on where it stood: its offset maps
each file to the end of its last whole line and a checksum of the bytes before
that end.  A line that has no end yet waits for it.  A file that has shrunk, or
whose bytes before the end are others than they were, is another file under an
old name and is read from its start, even if it has grown past the old place.
Files that are gone leave the offset; the rest of it grows with the number of
files, not with their bytes.

Ranges of more than ``split`` bytes are read by several tasks.  A line belongs
to the range that holds its first byte.

Defined cases: blank lines are left out; bytes that aren't UTF-8 become
replacement marks; a carriage return before a line end goes with it; a batch
also gives a last line without end.  A micro-batch that is run again after its file
was cut gives the lines that are still there.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, value string"
#: Bytes of a range that one task reads; of one read; before an offset that its checksum covers; of text in one batch of rows.
SPLIT, READ, MARKED, ROWS = 64 << 20, 1 << 20, 256, 4 << 20


@dataclass
class Range(InputPartition):
    """Lines whose first byte lies in [a, b) of what is read of a file, [begin, end)."""

    file: str
    a: int
    b: int
    begin: int
    end: int
    open_ended: bool


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def listed(path: str, glob: str) -> Iterator[pyarrow.fs.FileInfo]:
    """Files under a folder, or the one file, whose name fits; in order."""
    fs, root = opened(path)
    found = fs.get_file_info(root)
    every = [found] if found.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return iter(sorted((f for f in every if f.is_file and fnmatch.fnmatch(f.base_name, glob)), key=lambda f: f.path))


def mark(f: pa.NativeFile, end: int) -> int:
    """Checksum of the bytes before a place."""
    begin = max(0, end - MARKED)
    return zlib.crc32(f.read_at(end - begin, begin))


def last_line_end(f: pa.NativeFile, size: int) -> int:
    """The place behind the last line end before ``size``; read backwards."""
    at = size
    while at > 0:
        begin = max(0, at - READ)
        found = f.read_at(at - begin, begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def cut(file: str, begin: int, end: int, split: int, open_ended: bool) -> list[Range]:
    return [Range(file, a, min(a + split, end), begin, end, open_ended) for a in range(begin, end, split)]


def lines(f: pa.NativeFile, r: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of a range, in order; memory for one line and one read."""
    at, parts, place = (r.a, [], r.a) if r.a == r.begin else (r.a - 1, None, r.a)  # parts is None until a line begins
    while at < r.end:
        block = f.read_at(min(READ, r.end - at), at)
        if not block:
            break
        done = 0
        while (stop := block.find(b"\n", done)) >= 0:
            if parts is not None:
                parts.append(block[done:stop])
                yield place, b"".join(parts)
            parts, done, place = [], stop + 1, at + stop + 1
            if place >= r.b:
                return
        if parts is not None:
            parts.append(block[done:])
        at += len(block)
    if r.open_ended and parts is not None and (rest := b"".join(parts)):
        yield place, rest


def read_range(root: str, r: Range) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(root)
    at, values, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.string())], ["file", "at", "value"])

    with fs.open_input_file(r.file) as f:
        for place, line in lines(f, r):
            value = line.decode("utf-8", "replace").removesuffix("\r")
            if not value.strip():
                continue
            at.append(place)
            values.append(value)
            size += len(line)
            if size > ROWS:
                yield batch()
                at, values, size = [], [], 0
    if at:
        yield batch()


class LinesReader(DataSourceReader):
    """All lines that are there now."""

    def __init__(self, path: str, glob: str, split: int):
        self.path, self.glob, self.split = path, glob, split

    def partitions(self) -> list[Range]:
        return [r for f in listed(self.path, self.glob) for r in cut(f.path, 0, f.size, self.split, True)] or [Range("", 0, 0, 0, 0, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from read_range(self.path, partition)


class TailReader(DataSourceStreamReader):
    """Lines added since an offset: {file: [end of the last whole line, checksum of what stands before it]}."""

    def __init__(self, path: str, glob: str, split: int, from_end: bool):
        self.path, self.glob, self.split, self.from_end = path, glob, split, from_end
        self.seen: dict[str, tuple] = {}  # files that are as they were needn't be opened

    def now(self) -> dict[str, list[int]]:
        fs, _ = opened(self.path)
        seen, out = {}, {}
        for info in listed(self.path, self.glob):
            state = (info.size, info.mtime_ns)
            known = self.seen.get(info.path)
            if known is None or known[0] != state:
                try:
                    with fs.open_input_file(info.path) as f:
                        end = last_line_end(f, info.size)
                        known = state, [end, mark(f, end)]
                except OSError:  # gone since it was listed
                    continue
            seen[info.path], out[info.path] = known, known[1]
        self.seen = seen
        return out

    def initialOffset(self) -> dict:
        return self.now() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self.now()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        fs, _ = opened(self.path)
        out = []
        for file, (stop, checksum) in sorted(end.items()):
            if start.get(file) == [stop, checksum]:
                continue
            begin, before = start.get(file, (0, 0))
            if begin and (begin > stop or self._other(fs, file, begin, before)):
                begin = 0
            out += cut(file, begin, stop, self.split, False)
        return out

    @staticmethod
    def _other(fs: pyarrow.fs.FileSystem, file: str, end: int, checksum: int) -> bool:
        try:
            with fs.open_input_file(file) as f:
                return f.size() < end or mark(f, end) != checksum
        except OSError:
            return True

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from read_range(self.path, partition)


class AppendedLines(DataSource):
    """Options: path (a folder or file that driver and executors share), glob, split, start (``begin`` or ``end`` of the files that are there at first)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, str, int]:
        return self.options["path"], self.options.get("glob", "*.jsonl"), int(self.options.get("split", SPLIT))

    def reader(self, schema) -> LinesReader:
        return LinesReader(*self._options())

    def streamReader(self, schema) -> TailReader:
        return TailReader(*self._options(), self.options.get("start", "begin") == "end")


def read_appended(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of growing files as a stream."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").options(path=path, **options).load()


def read_from(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The lines that are there now, with their byte positions; large files by ranges."""
    spark.dataSource.register(AppendedLines)
    return spark.read.format("appended_lines").options(path=path, **options).load()
