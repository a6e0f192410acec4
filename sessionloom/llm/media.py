"""Media columns: archives of lossless images behind a custom Spark data source.

Writing: each task appends its members to one archive file in the shared
folder, and beside it writes an index of where each member lies; the commit
lists the archives.  Files of failed or repeated attempts are in no list and
are not read.
Reading: the plan cuts every archive into byte ranges; a range takes the
members that begin in it, found in the index, reads them in large blocks and
streams them as Arrow batches.  A member that cannot be read, or whose
checksum is wrong, is tried again alone by its own offset before it is given
out with an error in place of its bytes; no other member depends on it.  An
index entry that is damaged is taken from the member's own header instead.

A payload is stored as a grey 8-bit PNG of 192 columns.

Defined cases: a null text is an empty one (one row of spaces); null doc_ids
come back as null; repeated rows are members each; an empty table writes an
empty list and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sessionloom.llm.common import fresh_path, table, tune

WIDTH = 192
LEVEL = 1
#: In the index and before each member: offset of this header, length of the stored bytes, doc_id, bytes before filling up, crc32 of the stored bytes, doc_id known, crc32 of the above.
ENTRY = struct.Struct("<QQqQI?3xI")
LIST = "_archives.json"
#: Bytes of an archive that one read task takes, and that it reads at once.
RANGE, BLOCK = 8 << 20, 4 << 20
TRIES = 3
MEMBERS = "doc_id long, offset long, n_bytes long, media binary, error string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A payload of a positive multiple of WIDTH bytes as a grey 8-bit PNG, one byte a pixel."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The payload of an image that to_png() made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, data = 8, 0, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        if kind == b"IHDR":
            width = struct.unpack_from(">I", media, at + 8)[0]
        elif kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, filled up with spaces to a positive multiple of WIDTH, and their number before."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH), len(data)


def feature(payload: bytes) -> str:
    """Size, mean and deviation of the pixels, and an 8 by 8 average hash."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = [pixels[a : max(b, a + 1)] for a, b in ((len(pixels) * k // 8, len(pixels) * (k + 1) // 8) for k in range(8))]
    cells = np.array([band.reshape(len(band), 8, WIDTH // 8).mean(axis=(0, 2)) for band in bands])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{WIDTH}x{len(pixels)} mean={pixels.mean():.4f} sd={pixels.std():.4f} ahash={bits}"


class Member(NamedTuple):
    offset: int
    length: int
    doc: int | None
    n_bytes: int
    crc: int

    def packed(self) -> bytes:
        head = ENTRY.pack(self.offset, self.length, self.doc or 0, self.n_bytes, self.crc, self.doc is not None, 0)[:-4]
        return head + struct.pack("<I", zlib.crc32(head))

    @staticmethod
    def unpacked(data: bytes) -> Member | None:
        """Nothing if the checksum is wrong."""
        if len(data) != ENTRY.size or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            return None
        offset, length, doc, n, crc, known, _ = ENTRY.unpack(data)
        return Member(offset, length, doc if known else None, n, crc)


@dataclass
class Range(InputPartition):
    """The members of an archive that begin at start..stop-1; its size and number of members."""

    path: str
    start: int
    stop: int
    members: int


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    size: int
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        name, out, at = f"archive-{uuid.uuid4().hex}.bin", None, 0
        index, n, firsts = bytearray(), 0, [0]  # firsts: for each range the number of its first member
        try:
            for b in iterator:
                for doc, size, media in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media"))):
                    if out is None:
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder}/{name}")
                    while at >= len(firsts) * RANGE:
                        firsts.append(n)
                    head = Member(at, len(media), doc, size, zlib.crc32(media)).packed()
                    out.write(head)
                    out.write(media)
                    index += head
                    at, n = at + len(head) + len(media), n + 1
        finally:
            if out is not None:
                out.close()
        if out is None:
            return Written(None, 0, 0)
        firsts += [n] * (-(-at // RANGE) + 1 - len(firsts))
        with fs.open_output_stream(f"{folder}/{name}.index") as side:
            side.write(bytes(index) + np.array(firsts, "<u8").tobytes())
        return Written(name, at, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{LIST}") as out:
            out.write(json.dumps([[m.archive, m.size, m.members] for m in messages if m and m.archive]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is listed, so nothing is read."""


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{folder}/{LIST}") as f:
            listed = json.loads(f.read())
        ranges = [Range(f"{folder}/{a}", k, min(k + RANGE, size), n) for a, size, n in sorted(listed) for k in range(0, size, RANGE)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.stop:
            return
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        group: list[Member | None] = []
        size = 0
        for m in self.members(fs, partition):
            group.append(m)
            size += m.length + ENTRY.size if m else 0
            if size > BLOCK:
                yield self.batch(self.payloads(fs, partition.path, group))
                group, size = [], 0
        if group:
            yield self.batch(self.payloads(fs, partition.path, group))

    @staticmethod
    def read_at(fs: pyarrow.fs.FileSystem, path: str, at: int, size: int) -> bytes:
        """Bytes of a file, on a new handle for each try."""
        for left in range(TRIES - 1, -1, -1):
            try:
                with fs.open_input_file(path) as f:
                    return f.read_at(size, at)
            except OSError:
                if not left:
                    raise
        return b""

    def members(self, fs: pyarrow.fs.FileSystem, p: Range) -> Iterator[Member | None]:
        """What the index says of the range's members; None for one that neither it nor a header tells of."""
        first, last = np.frombuffer(self.read_at(fs, f"{p.path}.index", p.members * ENTRY.size + 8 * (p.start // RANGE), 16), "<u8").tolist()
        data = self.read_at(fs, f"{p.path}.index", first * ENTRY.size, (last - first) * ENTRY.size)
        end = p.start if p.start == 0 else None
        for k in range(0, len(data), ENTRY.size):
            m = Member.unpacked(data[k : k + ENTRY.size])
            if m is None and end is not None:
                m = Member.unpacked(self.read_at(fs, p.path, end, ENTRY.size))
            end = m.offset + ENTRY.size + m.length if m else None
            yield m

    def payloads(self, fs: pyarrow.fs.FileSystem, path: str, group: list[Member | None]) -> list[tuple]:
        """Rows of neighbouring members: read at once, those that fail again one by one."""
        known = [m for m in group if m]
        at, block = (known[0].offset, b"") if known else (0, b"")
        if known:
            with contextlib.suppress(OSError), fs.open_input_file(path) as f:
                block = f.read_at(known[-1].offset + ENTRY.size + known[-1].length - at, at)
        rows = []
        for m in group:
            if m is None:
                rows.append((None, None, None, None, "the index entry is damaged, and no header could be found"))
                continue
            begin, error = m.offset + ENTRY.size - at, None
            media = block[begin : begin + m.length]
            for _ in range(TRIES):
                if len(media) == m.length and zlib.crc32(media) == m.crc:
                    error = None
                    break
                error = f"member at {m.offset} is damaged"
                try:
                    media = self.read_at(fs, path, m.offset + ENTRY.size, m.length)
                except OSError as e:
                    error = str(e)
            if error and len(media) == m.length and zlib.crc32(media) == m.crc:
                error = None
            rows.append((m.doc, m.offset, m.n_bytes, None if error else media, error))
        return rows

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


class MediaArchive(DataSource):
    """``format("media_archive")`` with a path that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_media(docs: DataFrame, path: str) -> None:
    """Store each text's payload as an image in archives under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            filled = [payload_of(x) for x in b.column(1).to_pylist()]
            media = pa.array([to_png(p) for p, _ in filled], pa.binary())
            none = pa.nulls(b.num_rows, pa.int64())  # an offset is known once the member is in its archive
            yield pa.RecordBatch.from_arrays([b.column(0), none, pa.array([n for _, n in filled], pa.int64()), media, none.cast(pa.string())], ["doc_id", "offset", "n_bytes", "media", "error"])

    spark = docs.sparkSession
    tune(spark)
    spark.dataSource.register(MediaArchive)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEMBERS)
    rows.write.format("media_archive").mode("append").option("path", path).save()


def read_media(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("path", path).load()


def measured(media: DataFrame) -> DataFrame:
    """Digests and features of every member, from the bytes that were read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, m, error in zip(*(b.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media", "error"))):
                if error:
                    raise OSError(error)
                p = from_png(m)
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "media")
    write_media(table(spark, sf_dir, "documents"), path)
    return measured(read_media(spark, path))
