"""Near vectors through hashed bands: what meets grows with the rows, not with their square.

Random hyperplanes cut the space; the signs at ``bits`` of them are a band's
code, and vectors of one code meet.  Two vectors at cosine c have one sign at a
share p = 1 - acos(c) / pi of all planes, so bands enough that
1 - (1 - p^bits)^bands reaches the wanted recall find each pair at the
threshold with that probability, and nearer ones more surely, whatever the data are.
``bits`` follows the number of rows, so that a cell holds ``CELL`` of evenly spread ones.

Every score is the exact cosine.  A pair is given by the first band that both
share, so it comes once without a distinct over pairs.  A cell above ``BLOCK``
rows is cut into blocks that meet each other once; none is dropped or capped.

Defined cases: equal vectors are one, which stands by its least id, and rows
``equal`` give its other ids; null and zero vectors and those that hold nulls or
NaN are in no pair; vectors of different lengths are not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.similarity import ROWS, _blocks, sides, sound_rows
from sessionloom.operators.store import stored

#: Rows of a cell to aim at, and rows of one that meet as one block.
CELL, BLOCK = 1024, 8192
PAIRS = "a long, b long, copies_a long, copies_b long, score double"
COUNTS = "class_id long, n long"


def banding(rows: int, least: float, recall: float, cell: int = CELL) -> tuple[int, int]:
    """(bits of a band, bands) for so many rows."""
    bits = max(1, math.ceil(math.log2(max(rows, 2) / cell)))
    alike = 1 - math.acos(least) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(alike**bits))))


def _codes(vectors: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """The code of each vector in each band."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(vectors.shape[1], bands, bits))
    weights = 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(vectors), bands), np.int64)
    for band in range(bands):
        out[:, band] = (vectors @ planes[:, band] >= 0) @ weights
    return out


def _cells(bits: int, bands: int, seed: int):
    """(id, copies, vec) -> the same with the cells of each row, one a band; rows go on in the batches they come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(dims)])
            cells = np.empty((len(dims), bands), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cells[at] = _codes(flat[starts[at][:, None] + np.arange(dim)], bits, bands, seed)
            cells += np.arange(bands, dtype=np.int64) << bits
            offsets = pa.array(np.arange(len(dims) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], ["id", "copies", "vec", "cells"])

    return run


def _hits(r: dict, least: float, bits: int, bands: int, seed: int) -> Iterator[tuple]:
    """Places (x, y) in the two sides of a meeting that are at ``least`` or more and whose first common band is that of the cell, with their scores."""
    (ia, _, va), (ib, _, vb) = sides(r)
    band, same = r["cell"] >> bits, r["i"] == r["j"]
    ca = _codes(va, bits, bands, seed)
    cb = ca if same else _codes(vb, bits, bands, seed)
    norm_a, norm_b = (np.sqrt((v * v).sum(axis=1)) for v in (va, vb))
    unit = (vb / norm_b[:, None]).T
    for low in range(0, len(ia), ROWS):
        x, y = np.nonzero((va[low : low + ROWS] / norm_a[low : low + ROWS, None]) @ unit >= least - 1e-9)
        x = x + low
        new = ia[x] < ib[y] if same else np.ones(len(x), bool)
        for earlier in range(band):
            new &= ca[x, earlier] != cb[y, earlier]
        x, y = x[new], y[new]
        score = sum((va[x, d] * vb[y, d] for d in range(r["dim"])), np.zeros(len(x))) / (norm_a[x] * norm_b[y])
        yield tuple(c[score >= least] for c in (x, y, score))


def _pairs(*rule):
    """(cell, i, j, dim, two sides) -> pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                (ia, na, _), (ib, nb, _) = sides(r)
                for x, y, score in _hits(r, *rule):
                    turn = ia[x] > ib[y]
                    columns = [np.where(turn, ib[y], ia[x]), np.where(turn, ia[x], ib[y]), np.where(turn, nb[y], na[x]), np.where(turn, na[x], nb[y]), score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "copies_a", "copies_b", "score"])

    return run


def _counts(*rule):
    """(cell, i, j, dim, two sides) -> one row for each vector that the meeting links, with the rows it is linked to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                (ia, na, _), (ib, nb, _) = sides(r)
                la, lb = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
                for x, y, _ in _hits(r, *rule):
                    np.add.at(la, x, nb[y])
                    np.add.at(lb, y, na[x])
                ids, n = np.concatenate([ia, ib]), np.concatenate([la, lb])
                yield pa.RecordBatch.from_arrays([pa.array(c[n > 0]) for c in (ids, n)], ["class_id", "n"])

    return run


def _packed(rows: DataFrame) -> DataFrame:
    """rows(block, id, copies, vec) -> one row of arrays for each block and number of dimensions."""
    d = rows.select("block", F.size("vec").alias("dim"), "id", "copies", "vec")
    return d.repartition("block").sortWithinPartitions("block", "dim").mapInArrow(_blocks, "block long, dim int, ids binary, copies binary, vecs binary")


def _meetings(items: DataFrame, least: float, recall: float, cell: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, tuple]:
    """Sound rows, different vectors with their copies, the blocks that meet, and the rule of a hit."""
    if not (0 < least < 1 and 0 < recall < 1):
        raise ValueError("least and recall lie between 0 and 1")
    items.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = stored(sound_rows(items).where(F.exists("vec", lambda x: x != 0)), "rows")
    one = stored(rows.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "vec"), "vectors")
    bits, bands = banding(one.count(), least, recall, cell)
    coded = stored(one.mapInArrow(_cells(bits, bands, seed), "id long, copies long, vec array<float>, cells array<long>"), "cells")
    full = coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    full = stored(full.select("cell", F.ceil(F.col("n") / BLOCK).alias("parts")), "full")
    each = coded.select(F.explode("cells").alias("cell"), "id", "copies", "vec").join(full, "cell", "left")

    two = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("ids", "copies", "vecs")]
    zero = F.lit(0).cast("long")
    small = _packed(each.where("parts IS NULL").withColumnRenamed("cell", "block"))
    small = small.select(F.col("block").alias("cell"), zero.alias("i"), zero.alias("j"), "dim", *two("a"), *two("b"))
    # blocks of a full cell are numbered cell by cell; each pair of them meets once
    dealt = each.where("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    width = F.lit(1 << 24)
    large = _packed(dealt.withColumn("block", F.col("cell") * width + F.col("part"))).withColumn("cell", F.shiftright("block", 24)).withColumn("part", F.pmod("block", width)).join(full, "cell")
    first = large.select("cell", "dim", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), *two("a"))
    second = large.select("cell", "dim", F.explode(F.sequence(zero, "part")).alias("i"), F.col("part").alias("j"), *two("b"))
    return rows, one, small.unionByName(first.join(second, ["cell", "dim", "i", "j"])), (least, bits, bands, seed)


def near_pairs(items: DataFrame, least: float = 0.85, recall: float = 0.98, cell: int = CELL, seed: int = 11) -> DataFrame:
    """C10 at scale: items(id, vec) -> (a, b, copies_a, copies_b, score, equal), each pair of different vectors at ``least`` found with probability ``recall``.

    ``least`` lies over 0 and under 1.  A vector travels once for each band; their number grows with the rows to the power of about 0.28 at 0.85.
    """
    rows, one, met, rule = _meetings(items, least, recall, cell, seed)
    near = met.mapInArrow(_pairs(*rule), PAIRS).withColumn("score", F.round("score", 5)).withColumn("equal", F.lit(False))
    same = rows.join(one.where("copies > 1").select("vec", F.col("id").alias("a"), "copies"), "vec").where("id <> a")
    return near.unionByName(same.select("a", F.col("id").alias("b"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"), F.lit(1.0).alias("score"), F.lit(True).alias("equal")))


def near_links(items: DataFrame, least: float = 0.85, recall: float = 0.98, cell: int = CELL, seed: int = 11) -> DataFrame:
    """C10 as counts: (id, class_id, links) of each sound row: the least id of its vector, and how many other rows are near or equal to it.

    The links are those of ``near_pairs``; they are counted where they are found, so a group of near copies gives a row for each vector and cell, not its pairs.
    """
    rows, one, met, rule = _meetings(items, least, recall, cell, seed)
    linked = met.mapInArrow(_counts(*rule), COUNTS).groupBy("class_id").agg(F.sum("n").alias("n"))
    classes = one.join(linked, one["id"] == linked["class_id"], "left").select("vec", F.col("id").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.join(classes, "vec").select("id", "class_id", "links")


def _signed(dims: int):
    """(id, places) -> (id, vec): a place under ``dims`` takes one from its number, another adds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            n = np.bincount(row * (2 * dims) + b.column(1).flatten().to_numpy(), minlength=len(sizes) * 2 * dims).reshape(-1, 2 * dims)
            vec = (n[:, dims:] - n[:, :dims]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dims), pa.array(vec.ravel()))], ["id", "vec"])

    return run


def text_vectors(docs: DataFrame, key: str, text: str, words: int = 3, dims: int = 64) -> DataFrame:
    """(id, vec): signed counts of the hashed word shingles of each text, in place of a model that is not at hand; under ``words`` words, or null: all zero."""
    place = lambda w, i: F.pmod(F.xxhash64(F.slice(w, i, words)), F.lit(2 * dims)).cast("int")
    grams = lambda w: F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: place(w, i)))
    places = F.transform(F.array(t.tokens(F.col(text))), grams)[0]  # bound to a name, so that the words are found once
    d = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(places, F.array().cast("array<int>")).alias("places"))
    return d.mapInArrow(_signed(dims), "id long, vec array<float>")
