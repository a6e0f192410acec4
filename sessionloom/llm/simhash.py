"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  At most four
differing bits leave two segments with at most two between them (the worst of
three holds at least half of four).  For two 23-bit words at distance two or
less, the word between them lies within three of a codeword of the perfect
[23,12,7] Golay code, so both lie within four of it.  Decoding a segment to
all codewords within four (five on average) and joining on the codeword
indices of two segments therefore meets every link.  Equal fingerprints are
merged first; within a key only the edges of a spanning forest go on.

Defined cases: null and blank texts have fingerprint zero and link like any
other; a null doc_id takes part but never names a component while another id
is there; repeated rows share a component; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import LOWER, stored, table, tune
from sessionloom.llm.components import components

#: Generator polynomial of the [23,12,7] Golay code: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Parts in which the fingerprints of one component get its name.
SALTS = 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends[: -shingle]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    total, n = np.zeros(64, dtype=np.int64), len(hashes)
    for k in range(0, n, 1 << 14):
        part = np.array(hashes[k : k + (1 << 14)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, fp) per row; row is a hash of all its columns, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "row", "fp"])

    tune(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes all error patterns of weight four or less, and how many."""
    ones, bits = [0], [1 << i for i in range(23)]
    last = [(0, 0)]
    for _ in range(4):
        last = [(e | bits[i], i + 1) for e, start in last for i in range(start, 23)]
        ones += [e for e, _ in last]
    e = np.array(ones, dtype=np.int64)
    s = syndrome(e)
    order = np.argsort(s, kind="stable")
    e, s = e[order], s[order]
    count = np.bincount(s, minlength=2048)
    first = np.cumsum(count) - count
    out = np.full((2048, count.max()), -1, dtype=np.int64)
    out[s, np.arange(len(s)) - first[s]] = e
    return out, count


def segment_keys(fps: np.ndarray, patterns: np.ndarray) -> list[np.ndarray]:
    """Per segment an array (n, patterns): codeword indices, -1 where there is none."""
    out = []
    for start, bits in SEGMENTS:
        v = (fps >> np.uint64(start) & np.uint64((1 << bits) - 1)).astype(np.int64)
        e = patterns[syndrome(v)]
        out.append(np.where(e >= 0, (v[:, None] ^ e) >> 11, -1))
    return out


def keyed(fps: DataFrame) -> DataFrame:
    """(fp) -> (key, fp): about 85 keys each, of two segments' codeword indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, _ = error_patterns()
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(every), 2000):
                fp = every[k : k + 2000]
                seg = segment_keys(fp.view(np.uint64), patterns)
                for pair, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
                    a, c = seg[x][:, :, None], seg[y][:, None, :]
                    row, i, j = np.nonzero((a >= 0) & (c >= 0))
                    key = (pair << 24) | (seg[x][row, i] << 12) | seg[y][row, j]
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fp[row])], ["key", "fp"])

    return fps.mapInArrow(run, "key int, fp long")


class Forest:
    """Union-find over the fingerprints of one task; says which links are new."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = p.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def links(keys: np.ndarray, fps: np.ndarray, most: int, forest: Forest) -> list[tuple[int, int]]:
    """New links of sorted rows with equal keys.  Row i meets row i+1, i+2, ... of its key."""
    out: list[tuple[int, int]] = []
    alive, lag = np.arange(len(keys) - 1), 1
    while len(alive):
        alive = alive[alive + lag < len(keys)]
        alive = alive[keys[alive] == keys[alive + lag]]
        near = alive[np.bitwise_count((fps[alive] ^ fps[alive + lag]).view(np.uint64)) <= most]
        for i, j in zip(fps[near].tolist(), fps[near + lag].tolist()):
            if forest.join(i, j):
                out.append((i, j))
        lag += 1
    return out


def link_edges(rows: DataFrame, most: int = 4) -> DataFrame:
    """(key, fp) dealt and sorted by key -> (a, b), a forest of links per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, keys, fps = Forest(), np.empty(0, np.int32), np.empty(0, np.int64)
        for b in batches:
            keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if found := links(keys[:whole], fps[:whole], most, forest):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
            keys, fps = keys[whole:], fps[whole:]
        if found := links(keys, fps, most, forest):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def linked(prints: DataFrame, most: int = 4) -> DataFrame:
    """Stored prints(doc_id, row, fp) -> (doc_id, row, fp, root, component_id), root being one fingerprint of each component.  ``most`` is four or less: the keys are built for that."""
    if not 0 <= most <= 4:
        raise ValueError("the Golay keys meet links of at most four bits")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rows = keyed(distinct.select("fp")).repartition("key").sortWithinPartitions("key")
    roots = components(link_edges(rows, most))
    label = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    # A fingerprint without links names itself.  One component may hold a large part of the others, so these meet their name in SALTS parts.
    of_many = label.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    names = of_many.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    single = label.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    named = single.union(of_many.join(names, ["root", "salt"]).select("fp", "root", "component_id"))
    return prints.join(named, "fp").select("doc_id", "row", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) per row."""
    return linked(stored(fingerprints(docs, doc_id, text), "fingerprints"), most).drop("row", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, columns unchanged: that of the least id (null comes last), then of the least hash."""
    prints = linked(stored(fingerprints(docs), "fingerprints"))
    of_row = prints.groupBy("root", "doc_id", "row").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")
    kept = of_row.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"), F.col("first.n").alias("_times"))
    kept = stored(kept, "kept")
    rows = docs.withColumn("_hash", F.xxhash64(*docs.columns))

    def those(k: DataFrame) -> DataFrame:
        return rows.join(k, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_row")), "left_semi").select(*docs.columns)

    again = kept.where("_times > 1")  # the same row several times
    return those(kept) if again.isEmpty() else those(kept.where("_times = 1")).unionByName(those(again).dropDuplicates())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
