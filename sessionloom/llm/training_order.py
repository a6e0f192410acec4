"""Training-order materialisation of token-id sequences.

Documents become sequences of a fixed number of 16-bit token ids.  Every
sequence has a dense index (by bucket of a hash, then document id); a keyed
Feistel permutation with cycle-walking maps the index to its global slot.
Slots are dealt to partitions by range and written as shards of fixed stride,
so slot s lies at byte ``s % per_shard * stride`` of shard ``s // per_shard``,
and a reader goes on from any slot.  The shards are written range by range, so
that only a part of the records lies in shuffle files at a time.

A shard is written under a name of its own attempt and then renamed; its bytes
depend on the input and key alone, so a repeated task writes the same shard.

The query's ids are those of a byte-level BPE vocabulary, shifted past the
reserved ones, so every text can be had back from the shards.

Defined cases: null and empty texts are one sequence that holds the end id
only; null doc_ids are marked in the record; repeated rows get slots each; an
empty table gives no shards and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe
from sessionloom.llm.common import dropped, fresh_path, shuffles_dropped, stored, table, tune

PAD, END = 0, 1
RESERVED = 3
#: Documents of a bucket, about, and the least number of buckets: within one, documents are counted by one task.
PER_BUCKET, LEAST_BUCKETS = 1 << 15, 1024
#: Shards are written in so many goes, so that shuffle files hold that part of all records at a time; bytes that one writer takes.
WAVES, WRITER = 4, 128 << 20


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1; values that leave the range walk on until they are back."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [zlib.crc32(struct.pack("<qi", key, r)) << 32 | zlib.crc32(struct.pack("<iq", r, key)) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mixed(right, k) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


Encode = Callable[[list[str | None]], Iterable[np.ndarray]]


def byte_ids(texts: list[str | None]) -> list[np.ndarray]:
    """The UTF-8 bytes themselves as ids, past the reserved ones, and the end id."""
    return [np.append(np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8).astype("<u2") + RESERVED, END).astype("<u2") for x in texts]


def bpe_ids(path: str, pattern: str) -> Encode:
    """Ids of the BPE vocabulary of a rank file, and the end id; the codec is made in the worker."""
    most = max(bpe.read_ranks(path).values()) + RESERVED
    if most > 0xFFFF:
        raise ValueError(f"id {most} does not fit 16 bits")

    def encode(texts: list[str | None]) -> Iterator[np.ndarray]:
        for ids in bpe.codec(path, pattern).encode(texts):
            yield np.append(ids + RESERVED, END).astype("<u2")

    return encode


def bpe_text(ids: bytes, path: str, pattern: str) -> bytes:
    """The UTF-8 text of a document's ids, its parts joined in order."""
    held = np.frombuffer(ids, "<u2")
    return bpe.codec(path, pattern).decode(held[held >= RESERVED].astype("<u4") - RESERVED)


def record_type(seq_len: int) -> np.dtype:
    """A record as it lies in a shard: whose sequence it is, which part of the document, how many ids, the ids and padding."""
    return np.dtype([("doc", "<i8"), ("known", "?"), ("", "V3"), ("part", "<i4"), ("n", "<u4"), ("ids", "<u2", (seq_len,))])


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Bytes laid end to end as an array of binaries."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


class Order:
    """What a reader needs: the folder, its sequence length, counts and stride."""

    def __init__(self, path: str, seq_len: int, n: int, per_shard: int):
        self.path, self.seq_len, self.n, self.per_shard = path, seq_len, n, per_shard
        self.stride = record_type(seq_len).itemsize


def encoded(docs: DataFrame, seq_len: int, encode: Encode) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids, bucket, at, n): n sequences each, the first of them the at-th of its bucket."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    buckets = max(LEAST_BUCKETS, 1 << (d.count() // PER_BUCKET).bit_length())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = pa.array([x.tobytes() for x in encode(part.column(1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids], ["doc_id", "digest", "ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, next_at = -1, 0
        for b in batches:
            own = b.column(2).to_numpy()
            n = -(-np.diff(np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: b.num_rows + 1]).astype(np.int64) // (2 * seq_len))
            if not len(own):
                continue
            before = np.cumsum(n) - n
            first = np.flatnonzero(np.concatenate([[own[0] != bucket], own[1:] != own[:-1]]))
            back = np.zeros(len(own), np.int64)
            back[first] = before[first] - np.concatenate([[0], before[first[:-1]]]) if len(first) else 0
            at = before - np.cumsum(back)
            at[: first[0] if len(first) else len(own)] += next_at
            bucket, next_at = own[-1], int(at[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(at), pa.array(n)], ["doc_id", "ids", "bucket", "at", "n"])

    d = d.mapInArrow(tokens, "doc_id long, digest long, ids binary").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int"))
    dealt = d.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "digest").select("doc_id", "ids", "bucket")
    return dealt.mapInArrow(numbered, "doc_id long, ids binary, bucket int, at long, n long")


def materialise(docs: DataFrame, path: str, seq_len: int = 256, key: int = 20240229, per_shard: int = 8192, encode: Encode = byte_ids, waves: int = WAVES) -> Order:
    """Write docs(doc_id, text) to ``path`` (a URI that executors share) in training order."""
    spark = docs.sparkSession
    tune(spark)
    over: list[str] = []
    d = stored(encoded(docs, seq_len, encode), "token-ids", over, compression="zstd")
    totals = {r[0]: r[1] for r in d.groupBy("bucket").agg(F.sum("n")).collect()}  # a row for each PER_BUCKET documents, about
    offsets, n = np.zeros(max(totals, default=0) + 1, np.int64), 0
    for b in sorted(totals):
        offsets[b] = n
        n += totals[b]
    order, kind = Order(path, seq_len, n, per_shard), record_type(seq_len)
    sent = spark.sparkContext.broadcast(offsets)

    def sequences(low: int, high: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 500):
                    b = batch.slice(k, 500)
                    doc, ids = b.column(0), b.column(1)
                    times = b.column(4).to_numpy()
                    row = np.repeat(np.arange(b.num_rows), times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    slots = feistel(sent.value[b.column(2).to_numpy()[row]] + b.column(3).to_numpy()[row] + part, n, key)
                    here = np.flatnonzero((slots >= low) & (slots < high))
                    row, part, slots = row[here], part[here], slots[here]
                    edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset :][: b.num_rows + 1].astype(np.int64) // 2
                    start = edges[row] + part * seq_len
                    held = np.minimum(edges[row + 1] - start, seq_len)
                    out = np.zeros(len(row), kind)
                    out["doc"], out["known"] = doc.fill_null(0).to_numpy()[row], doc.is_valid().to_numpy(zero_copy_only=False)[row]
                    out["part"], out["n"] = part, held
                    out["ids"][np.arange(seq_len) < held[:, None]] = bpe.gathered(np.frombuffer(ids.buffers()[2], "<u2"), start, held, np.arange(len(row)))
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(slots // per_shard), binaries(out, np.full(len(row), kind.itemsize))], ["slot", "shard", "record"])

        return run

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(path)
        fs.create_dir(folder, recursive=True)
        shard, out, temporary, held = None, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(temporary, f"{folder}/{shard_name(shard)}")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([held], pa.int64())], ["shard", "n"])

        for b in batches:
            shards, records = b.column(1).to_numpy(), b.column(2)
            first = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            for low, high in zip(first, [*first[1:], len(shards)]):
                if shards[low] != shard:
                    if out is not None:
                        yield close()
                    shard, held = int(shards[low]), 0
                    temporary = f"{folder}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                out.write(records.buffers()[2][(records.offset + int(low)) * kind.itemsize : (records.offset + int(high)) * kind.itemsize])
                held += int(high - low)
        if out is not None:
            yield close()

    shards, written = -(-n // per_shard), 0
    edges = [shards * w // waves for w in range(waves + 1)]
    for low, high in zip(edges, edges[1:]):
        if low == high:
            continue
        # A writer takes whole shards, WRITER bytes of them or few enough that every partition has some.
        parts = min(high - low, max(-(-(high - low) * per_shard * kind.itemsize // WRITER), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        rows = d.mapInArrow(sequences(low * per_shard, high * per_shard), "slot long, shard long, record binary")
        ranged = rows.repartitionById(parts, F.floor((F.col("shard") - low) * parts / (high - low)).cast("int")).sortWithinPartitions("slot")
        with shuffles_dropped(spark):
            written += ranged.mapInArrow(write, "shard long, n long").agg(F.sum("n")).first()[0]
    if written != n:
        raise RuntimeError(f"{written} of {n} sequences were written")
    dropped(over)
    return order


def read(spark: SparkSession, order: Order, first: int = 0, last: int | None = None) -> DataFrame:
    """Slots first..last-1 in the order written: (slot, doc_id, part, ids), one task per shard."""
    last = order.n if last is None else min(last, order.n)
    shards = range(first // order.per_shard, -(-last // order.per_shard)) if last > first else range(0)
    path, per_shard, kind = order.path, order.per_shard, record_type(order.seq_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(path)
        for b in batches:
            for shard in b.column(0).to_pylist():
                low, high = max(first, shard * per_shard), min(last, (shard + 1) * per_shard)
                with fs.open_input_file(f"{folder}/{shard_name(shard)}") as f:
                    for k in range(low, high, 2048):
                        m = min(2048, high - k)
                        r = np.frombuffer(f.read_at(m * kind.itemsize, (k - shard * per_shard) * kind.itemsize), kind)
                        held = r["n"].astype(np.int64)
                        ids = binaries(r["ids"][np.arange(order.seq_len) < held[:, None]], 2 * held)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + m)), pa.array(r["doc"], mask=~r["known"]), pa.array(r["part"]), ids], ["slot", "doc_id", "part", "ids"])

    frame = spark.range(shards.start, shards.stop, 1, max(1, min(len(shards), 10_000)))
    return frame.mapInArrow(run, "slot long, doc_id long, part int, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot as it is read back: its document, part, number of ids and their sha256."""
    order = materialise(table(spark, sf_dir, "documents"), fresh_path(spark, "training-order"), encode=bpe_ids(*bpe.default_vocabulary()))
    return read(spark, order).select("slot", "doc_id", "part", (F.octet_length("ids") / 2).cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"))
