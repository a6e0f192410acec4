"""Most frequent phrases of a group, counted as hashes first.

A pass counts the 64-bit hashes of all phrases of one length: sorted runs of
them are dealt by their first bits, and what each bucket gives are its k most
frequent ones, ties included.  A hash's count is at least that of each phrase that
has it.  A group's k-th largest is its cut.  A second pass spells out and counts only
phrases whose hash is as frequent as the cut.  Should phrases that share a hash have
set a cut too high, a group's k-th largest exact count lies below it; then all
phrases are spelt out, so the result is exact, whatever the hash.  Phrases of fewer
words rank behind all longer ones, so they are counted only in groups that have
fewer than k longer ones.

Defined cases: null texts have no words; a null group is a group; stop words
and those of one or two letters are left out before phrases are formed; of equally
frequent phrases the first by code point comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sessionloom.operators.store import stored

#: Bits of a phrase's hash, and those of them by which the second pass knows a frequent one.
BITS, MARK_BITS = 64, 20
#: Bytes of text whose words are told apart at once, or one text; bytes of text for each bucket of hashes, about, and the least bits of a bucket.
AT_ONCE, PER_BUCKET, LEAST_BITS = 16 << 20, 16 << 20, 6
#: Each byte of a text, or a space where it is ASCII and no letter, or begins a character beyond U+024F.
KEPT = np.array([b if b > 127 and not 0xCA <= b or chr(b).isascii() and (chr(b).isalnum() or b == 95) else 32 for b in range(256)], np.uint8)


def spaced(raw: np.ndarray) -> np.ndarray:
    """UTF-8 with spaces for all bytes of characters that are not LETTERS: A-Za-z0-9_ and U+00C0 to U+024F."""
    out = KEPT[raw]
    if len(at := np.flatnonzero(raw > 127)):
        b, before = raw[at], raw[np.maximum(at - 1, 0)]
        inner = (b & 0xC0) == 0x80
        wrong = inner & ((before < 0xC3) | (before > 0xC9) | (before == 0xC9) & (b >= 0x90))
        out[at[wrong]] = 32
        out[at[wrong & (before == 0xC9)] - 1] = 32
        out[at[(b >= 0xC0) & (b < 0xC3)]] = 32
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Groups and texts, AT_ONCE bytes of them; characters that are no letters are spaces."""
    for b in batches:
        texts = b.column(1).cast(pa.large_string())
        upto, at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: b.num_rows + 1], 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + AT_ONCE, "right")) - 1)
            own = upto[at : end + 1] - upto[at]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[upto[at] : upto[end]]
            yield b.column(0).slice(at, end - at), pa.LargeStringArray.from_buffers(end - at, pa.py_buffer(own), pa.py_buffer(spaced(raw)))
            at = end


def _grams(texts: pa.Array, n: int, stop: tuple[str, ...], bits: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(row, hash) of each phrase of n words; the different words, the places among them of the words that count, and the first of each phrase."""
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten().dictionary_encode()
    each, places = flat.dictionary, flat.indices.to_numpy()
    counts = pc.and_(pc.greater(pc.utf8_length(each), 2), pc.invert(pc.is_in(each, pa.array(stop, each.type)))).to_numpy(zero_copy_only=False)
    held = counts[places]
    row, places = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))[held], places[held]
    hashes = pd.util.hash_array(each.to_numpy(zero_copy_only=False), categorize=False) if len(each) else np.empty(0, np.uint64)
    first = np.flatnonzero(row[: 1 - n] == row[n - 1 :])
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[places[first + k]]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return row[first], h >> np.uint64(64 - bits) << np.uint64(64 - bits), each, places, first


def _binaries(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """data between the edges, as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _ranked(counted: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k most frequent keys of a group."""
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), key)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _frequent_hashes(docs: DataFrame, group: str, stop: tuple[str, ...], n: int, k: int, bits: int) -> DataFrame:
    """(group, hash, n): of each bucket of hashes the k most frequent, ties included, that a group has twice or more."""
    own = docs.schema[group]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = max(LEAST_BITS, (size // PER_BUCKET).bit_length())
    runs = StructType([own, StructField("bucket", IntegerType()), StructField("hashes", BinaryType()), StructField("counts", BinaryType())])
    out = StructType([own, StructField("hash", LongType()), StructField("n", LongType())])

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, texts in _parts(batches):
            row, h, *_ = _grams(texts, n, stop, bits)
            kinds = groups.dictionary_encode(null_encoding="encode")
            kind = kinds.indices.to_numpy()[row]
            order = np.argsort(kind, kind="stable")
            ends = np.searchsorted(kind[order], np.arange(len(kinds.dictionary) + 1))
            for g, (low, high) in enumerate(zip(ends, ends[1:])):
                keys, counts = np.unique(h[order[low:high]], return_counts=True)
                buckets, first = np.unique(keys >> np.uint64(64 - top), return_index=True)
                edges = np.append(first, len(keys))
                named = kinds.dictionary.take(pa.array(np.full(len(buckets), g)))
                yield pa.RecordBatch.from_arrays([named, pa.array(buckets.astype(np.int32)), _binaries(keys, edges), _binaries(counts.astype(np.uint32), edges)], runs.names)

    def most_frequent(rows: pa.Table) -> pa.Table:
        keys, counts = (np.frombuffer(b"".join(rows[c].to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("counts", np.uint32)))
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        least = max(2, np.partition(total, -k)[-k] if len(total) >= k else 2)
        some = np.flatnonzero(total >= least)
        named = rows[group].take(pa.array(np.zeros(len(some), np.int64)))
        return pa.table([named, pa.array(keys[first[some]].view(np.int64)), pa.array(total[some])], names=out.names)

    return docs.mapInArrow(sorted_runs, runs).groupBy("bucket", group).applyInArrow(most_frequent, out)


def _most_frequent(docs: DataFrame, group: str, stop: tuple[str, ...], n: int, k: int, bits: int) -> DataFrame:
    """docs(group, lower-case text) -> (group, phrase, n, rank) of phrases of n words that a group has twice or more."""
    spelt = StructType([docs.schema[group], StructField("phrase", StringType()), StructField("n", LongType())])

    def spelling(marks: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked = np.full(1 << MARK_BITS, marks is None)
            if marks is not None:
                marked[marks] = True
            for groups, texts in _parts(batches):
                row, h, each, places, first = _grams(texts, n, stop, bits)
                some = np.flatnonzero(marked[h >> np.uint64(64 - MARK_BITS)])
                named = pc.binary_join_element_wise(*(each.take(pa.array(places[first[some] + i])) for i in range(n)), pa.scalar(" ", each.type))
                held = pa.table([groups.take(pa.array(row[some])), named.cast(pa.string())], names=["g", "key"])
                counted = held.group_by(["g", "key"], use_threads=False).aggregate([([], "count_all")]).select(["g", "key", "count_all"])
                yield from counted.rename_columns(spelt.names).combine_chunks().to_batches()

        return run

    def spelt_out(marks: np.ndarray | None) -> DataFrame:
        counted = docs.mapInArrow(spelling(marks), spelt).groupBy(group, "phrase").agg(F.sum("n").alias("n")).where("n >= 2")
        return stored(_ranked(counted, group, "phrase", k), "phrases")

    def cut(top: DataFrame, name: str) -> DataFrame:
        """The k-th largest count of each group; 2 where there are fewer."""
        return top.groupBy(F.col(group).alias(f"{name}_of")).agg(F.when(F.count("*") == k, F.min("n")).otherwise(2).alias(name))

    cells = stored(_frequent_hashes(docs, group, stop, n, k, bits), "phrase-hashes")
    cuts = stored(cut(_ranked(cells, group, "hash", k), "cut"), "phrase-cuts")
    frequent = cells.join(cuts, F.col(group).eqNullSafe(F.col("cut_of"))).where("n >= cut")
    marks = frequent.select(F.shiftrightunsigned("hash", 64 - MARK_BITS)).distinct().collect()  # 2^MARK_BITS at most
    top = spelt_out(np.array([r[0] for r in marks], np.int64))
    both = cuts.join(cut(top, "exact"), F.col("cut_of").eqNullSafe(F.col("exact_of")), "left")
    return top if both.where(F.col("cut") > F.coalesce("exact", F.lit(2))).isEmpty() else spelt_out(None)


def phrases(docs: DataFrame, group: str, stop: tuple[str, ...], k: int = 5, bits: int = BITS) -> DataFrame:
    """K3: trigrams, then bigrams, of words that are not stop words, seen twice or more; the k most frequent of a group."""
    d = docs.select(group, F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    parts = []
    for n in (3, 2):
        top = _most_frequent(d, group, stop, n, k, bits)
        parts.append(top.select(group, F.lit(n).alias("size"), "phrase", "n"))
        full = top.where(F.col("rank") == k).select(F.col(group).alias("_g"))
        d = d.join(full, F.col(group).eqNullSafe(F.col("_g")), "left_anti")
        if d.isEmpty():
            break
    w = Window.partitionBy(group).orderBy(F.col("size").desc(), F.col("n").desc(), "phrase")
    whole = parts[0].union(parts[1]) if len(parts) == 2 else parts[0]
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
