"""Signatures, similarity, search and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.store import stored


def signature_groups(errors: DataFrame, least: int = 2) -> DataFrame:
    """Errors of equal signature: how many, of how many sessions, the top types, first and last id."""
    d = errors.withColumn("signature", t.short_hash(t.normalised(F.col("text"))))
    # Both results below come from this one aggregation, whose exchange Spark uses again.
    d = d.groupBy("signature", "lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    kinds = d.groupBy("signature", "lang").agg(F.sum("n").alias("n"))
    top = kinds.groupBy("signature").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "lang"))), lambda x: x["lang"]), 1, 3), ",").alias("top"))
    out = d.groupBy("signature").agg(F.sum("n").alias("n"), F.count_distinct("source").alias("sources"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"))
    return out.where(F.col("n") >= least).join(top, "signature")


def cosine(a: Column, b: Column) -> Column:
    """Zero vectors are at similarity 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


#: Different vectors of a block, and rows of a block that are compared at once.
BLOCK, ROWS = 8192, 512
#: Rows of a part of a label, and pairs that are scored at once.
PART, HITS = 4096, 1 << 19


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, id, copies, vec) in order of the keys -> one row for each set of keys, the last of which is the number of dimensions."""
    own, ids, copies, vecs = None, [], [], []

    def row() -> pa.RecordBatch:
        data = [np.concatenate(x).tobytes() for x in (ids, copies, vecs)]
        return pa.RecordBatch.from_arrays([*(pa.array([x], k) for x, k in zip(own, kinds)), *(pa.array([x], pa.binary()) for x in data)], [*names, "ids", "copies", "vecs"])

    for b in batches:
        names, kinds = b.schema.names[:-3], b.schema.types[:-3]
        keys = list(zip(*(b.column(k).to_pylist() for k in range(len(names)))))
        edges = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]] + [len(keys)]
        for low, high in zip(edges, edges[1:]):
            if keys[low] != own:
                if own is not None:
                    yield row()
                own, ids, copies, vecs = keys[low], [], [], []
            part = b.slice(low, high - low)
            ids.append(part.column("id").to_numpy())
            copies.append(part.column("copies").to_numpy())
            vecs.append(part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float32))
    if own is not None:
        yield row()


def sides(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, copies, vectors) of both sides of a pair of blocks."""
    return ((np.frombuffer(r[f"ids_{k}"], np.int64), np.frombuffer(r[f"copies_{k}"], np.int64), np.frombuffer(r[f"vecs_{k}"], np.float32).reshape(-1, r["dim"]).astype(np.float64)) for k in "ab")


def _block_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (ia, na, va), (ib, nb, vb) = sides(r)
                # sums run in order of place, as the SQL's do, so that rounded scores are equal
                norm_a, norm_b = (np.sqrt(sum((v[:, k] * v[:, k] for k in range(r["dim"])), np.zeros(len(v)))) for v in (va, vb))
                near_b = vb / norm_b[:, None]
                for k in range(0, len(ia), ROWS):
                    x, y = np.nonzero((va[k : k + ROWS] / norm_a[k : k + ROWS, None]) @ near_b.T >= least - 1e-9)
                    x = x + k
                    once = ia[x] < ib[y] if r["i"] == r["j"] else np.ones(len(x), bool)
                    x, y = x[once], y[once]
                    score = sum((va[x, d] * vb[y, d] for d in range(r["dim"])), np.zeros(len(x))) / (norm_a[x] * norm_b[y])
                    hit = score >= least
                    x, y, score = x[hit], y[hit], score[hit]
                    turn = ia[x] > ib[y]
                    columns = [np.where(turn, ib[y], ia[x]), np.where(turn, ia[x], ib[y]), np.where(turn, nb[y], na[x]), np.where(turn, na[x], nb[y]), score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "copies_a", "copies_b", "score"])

    return run


def blocks_met(one: DataFrame, size: int) -> DataFrame:
    """one(id, vec), with copies or without -> each pair of blocks of about ``size`` rows once, as arrays, by number of dimensions."""
    if "copies" not in one.columns:
        one = one.withColumn("copies", F.lit(1).cast("long"))
    blocks = max(1, -(-one.count() // size))
    packed = (
        one.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.size("vec").alias("dim"), "id", "copies", "vec")
        .repartition("block").sortWithinPartitions("block", "dim").mapInArrow(_blocks, "block long, dim int, ids binary, copies binary, vecs binary")
    )
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("ids", "copies", "vecs")]
    first = packed.select("dim", F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), *side("a"))
    second = packed.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), "block")).alias("i"), F.col("block").alias("j"), *side("b"))
    return first.join(second, ["dim", "i", "j"])


def _labelled_pairs(least: float):
    """Pairs of blocks of one label -> (a, b, score); copies are rows like others, and a score that is not a number counts as near, as it does in SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ia, _, va), (ib, _, vb) = sides(r)
                # sums run in order of place, as the SQL's do, so that rounded scores are equal
                norm_a, norm_b = (np.sqrt(sum((v[:, k] * v[:, k] for k in range(r["dim"])), np.zeros(len(v)))) for v in (va, vb))
                with np.errstate(invalid="ignore", over="ignore"):
                    unit_a, unit_b = va / norm_a[:, None], vb / norm_b[:, None]
                    for k in range(0, len(ia), ROWS):
                        x, y = np.nonzero(~(unit_a[k : k + ROWS] @ unit_b.T < least - 1e-9))
                        x = x + k
                        once = ia[x] < ib[y] if r["i"] == r["j"] else np.ones(len(x), bool)
                        x, y = x[once], y[once]
                        for at in range(0, len(x), HITS):
                            p, q = x[at : at + HITS], y[at : at + HITS]
                            score = sum((va[p, d] * vb[q, d] for d in range(r["dim"])), np.zeros(len(p))) / (norm_a[p] * norm_b[q])
                            hit = ~(score < least)
                            p, q, score = p[hit], q[hit], score[hit]
                            turn = ia[p] > ib[q]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.where(turn, ib[q], ia[p]), np.where(turn, ia[p], ib[q]), score)], ["a", "b", "score"])

    return run


def duplicate_pairs(items: DataFrame, block: str, least: float) -> DataFrame:
    """Pairs of one block at ``least`` similarity or more; the block bounds what meets.

    Rows of a block meet as arrays, some thousands at once, so that a block of any size falls
    into many tasks.  Null and zero vectors and those that hold nulls are in no pair.
    """
    items.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sound = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()) & F.exists("vec", lambda x: x != 0)
    rows = items.where(F.col(block).isNotNull()).select(F.col(block).alias("of"), F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where(sound)
    parts = rows.groupBy("of").agg(F.ceil(F.count("*") / PART).alias("parts"))
    numbered = stored(parts.select("of", "parts", F.monotonically_increasing_id().alias("own")), "blocks")
    packed = (
        rows.join(numbered, "of").select("own", "parts", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.size("vec").alias("dim"), "id", F.lit(1).cast("long").alias("copies"), "vec")
        .repartition("own", "part").sortWithinPartitions("own", "parts", "part", "dim").mapInArrow(_blocks, "own long, parts long, part long, dim int, ids binary, copies binary, vecs binary")
    )
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("ids", "copies", "vecs")]
    first = packed.select("own", "dim", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"), *side("a"))
    second = packed.select("own", "dim", F.explode(F.sequence(F.lit(0).cast("long"), "part")).alias("i"), F.col("part").alias("j"), *side("b"))
    met = first.join(second, ["own", "dim", "i", "j"]).mapInArrow(_labelled_pairs(least), "a long, b long, score double")
    return met.select("a", "b", F.round("score", 5).alias("score"))


def all_duplicate_pairs(items: DataFrame, least: float) -> DataFrame:
    """C10 over all rows: items(id, vec) -> pairs of different vectors at ``least`` or more, and the copies of each.

    Equal vectors are one, which stands by its least id; ``equal`` rows give its
    other ids.  All pairs of ids follow from both.  Blocks of vectors meet each
    other once, as arrays.  Null and zero vectors and those that hold nulls or
    NaN are in no pair; vectors of different lengths are not compared.
    """
    spark = items.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sound = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    rows = items.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where(sound)
    one = rows.groupBy("vec").agg(F.min("id").alias("a"), F.count("*").alias("copies"))
    met = blocks_met(one.select(F.col("a").alias("id"), "copies", "vec"), BLOCK).mapInArrow(_block_pairs(least), "a long, b long, copies_a long, copies_b long, score double")
    near = met.select("a", "b", "copies_a", "copies_b", F.round("score", 5).alias("score"), F.lit(False).alias("equal"))
    same = rows.join(one.where("copies > 1"), "vec").where("id <> a").select("a", F.col("id").alias("b"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"), F.lit(1.0).alias("score"), F.lit(True).alias("equal"))
    return near.unionByName(same)


def sound_rows(items: DataFrame) -> DataFrame:
    """items(id, vec) without null vectors and those that hold nulls or NaN."""
    rows = items.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    return rows.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)))


def _packed(rows: DataFrame, blocks: int, side: str) -> DataFrame:
    """rows(id, vec) as arrays, one row for each block and number of dimensions."""
    d = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.size("vec").alias("dim"), "id", F.lit(1).cast("long").alias("copies"), "vec")
    d = d.repartition("block").sortWithinPartitions("block", "dim").mapInArrow(_blocks, "block long, dim int, ids binary, copies binary, vecs binary")
    return d.select("block", "dim", F.col("ids").alias(f"ids_{side}"), F.col("vecs").alias(f"vecs_{side}"))


def _block_topk(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (iq, vq), (iv, vv) = ((np.frombuffer(r[f"ids_{s}"], np.int64), np.frombuffer(r[f"vecs_{s}"], np.float32).reshape(-1, r["dim"]).astype(np.float64)) for s in "qv")
                nq, nv = (np.sqrt(sum((v[:, d] * v[:, d] for d in range(r["dim"])), np.zeros(len(v)))) for v in (vq, vv))
                nq, nv = np.where(nq > 0, nq, np.inf), np.where(nv > 0, nv, np.inf)  # zero vectors are at similarity 0
                unit = vv / nv[:, None]
                for at in range(0, len(iq), ROWS):
                    near = (vq[at : at + ROWS] / nq[at : at + ROWS, None]) @ unit.T
                    near[iq[at : at + ROWS, None] == iv] = -np.inf
                    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -2.0)
                    x, y = np.nonzero(near >= np.maximum(least - 1e-9, -2.0)[:, None])
                    score = sum((vq[at + x, d] * vv[y, d] for d in range(r["dim"])), np.zeros(len(x))) / (nq[at + x] * nv[y])
                    order = np.lexsort((iv[y], -score, x))
                    x, y, score = x[order], y[order], score[order]
                    place = np.arange(len(x)) - np.searchsorted(x, x)
                    best = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(iq[at + x[best]]), pa.array(iv[y[best]]), pa.array(score[best])], ["query_id", "id", "score"])

    return run


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, least: float) -> DataFrame:
    """Q15: the k nearest to each query vector, then those over the threshold.

    The stated set of queries meets all vectors in blocks, as arrays; each block gives its k best of each query, and only these are ranked.
    Null vectors and those that hold nulls or NaN are left out; vectors of different lengths are not compared.
    """
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    v, q = sound_rows(vectors), sound_rows(query)
    blocks, asked = (max(1, -(-x.count() // BLOCK)) for x in (v, q))
    every = _packed(q, asked, "q").drop("block").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = every.join(_packed(v, blocks, "v"), ["dim", "block"]).mapInArrow(_block_topk(k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return met.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") >= least)).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def jaccard_pairs(items: DataFrame, least: float) -> DataFrame:
    """Pairs of different token sets at ``least`` or more, through the rarest-first prefix of each set.

    A set stands for all names that have it: its least id and their number.
    Two sets at Jaccard ``least`` share one of their first n - ceil(least n) + 1
    tokens in order of rarity, so only those are joined.
    """
    d = items.select("id", F.array_sort(F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda x: x != ""))).alias("tok")).where(F.size("tok") > 0)
    d = d.groupBy("tok").agg(F.min("id").alias("id"), F.count("*").alias("names"))
    each = d.select("id", "names", F.explode("tok").alias("w"))
    ranked = each.join(each.groupBy("w").agg(F.count("*").alias("df")), "w").groupBy("id", "names").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"]).alias("tok"))
    keep = F.size("tok") - F.ceil(F.lit(least) * F.size("tok")).cast("int") + 1
    prefix = ranked.select("id", "names", "tok", F.explode(F.slice("tok", 1, keep)).alias("w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    inter, union = F.size(F.array_intersect("a.tok", "b.tok")), F.size(F.array_union("a.tok", "b.tok"))
    d = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.id") < F.col("b.id")) & (inter >= F.lit(least) * union))
    return d.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.names").alias("names_a"), F.col("b.names").alias("names_b"), F.round(inter / union, 6).alias("jaccard")).distinct()


def keyword_search(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Q14: share of the query's terms that a text holds; the k best."""
    hit = sum((F.lower("text").contains(w).cast("int") for w in terms), F.lit(0))
    return docs.select("doc_id", F.round(hit / len(terms), 6).alias("score")).where("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(k)


def refine(docs: DataFrame, fields: list[str], terms: list[str]) -> DataFrame:
    """Any term in any field; fields are tested one by one, so no term spans two."""
    hit = F.lit(False)
    for f in fields:
        for w in terms:
            hit = hit | F.coalesce(F.lower(F.col(f)).contains(w.lower()), F.lit(False))
    return docs.where(hit)
