"""Order-dependent leader clustering over all rows, and clustering anew around hits.

In order of id a vector joins the nearest centroid at the threshold, or begins
a cluster; a centroid is the mean of its members.  The rule is sequential, but
it falls apart.  A sum S of members with lengths r has |S| >= threshold * sum(r), as each
joined at an angle of that cosine or less; so v . S >= threshold * |v| |S| gives v . S >=
threshold^2 * |v| * sum(r), and then some member is at cosine threshold^2 or more to v.  So a
cluster lies within one component of the graph that links vectors at that cosine, and
each component can be worked through by itself, with the sequential result.

Vectors are compared in blocks, as arrays; a pair of blocks gives a forest, not its
pairs.  The rows of a component stream through one task in order, which holds
the centroids and no rows; equal vectors are one node of the graph.

Defined cases: null vectors and those that hold nulls or NaN are left out; a
zero vector is a cluster of its own; of equal scores the older cluster; rows
with one id stand in the order of their vectors; vectors of different lengths are never linked.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.similarity import blocks_met
from sessionloom.operators.store import stored

#: Vectors of a block, and rows of one that are compared at once; what rounding may take from a cosine.
BLOCK, ROWS, MARGIN = 4096, 512, 1e-6
#: What single precision may take from a cosine for each dimension, and pairs that are scored at once.
SINGLE, PAIRS = 2.0**-23, 1 << 18
CLUSTERS = "id long, cluster long, size long, slug string"


def _forest(least: float):
    """Pairs of blocks -> (a, b): each vector that is linked to one of lesser id, with the least it reaches within the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ia, va), (ib, vb) = ((np.frombuffer(r[f"ids_{k}"], np.int64), np.frombuffer(r[f"vecs_{k}"], np.float32).reshape(-1, r["dim"]).astype(np.float64)) for k in "ab")
                # Cosines in single precision find the near pairs, and those near the threshold are taken again in double.
                ua, ub = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (va, vb))
                fa, fb = ua.astype(np.float32), ub.T.astype(np.float32)
                found = [np.nonzero(fa[k : k + ROWS] @ fb >= least - SINGLE * (r["dim"] + 4)) for k in range(0, len(fa), ROWS)]
                x, y = np.concatenate([(p + n * ROWS).astype(np.int32) for n, (p, _) in enumerate(found)]), np.concatenate([q.astype(np.int32) for _, q in found])
                near = np.concatenate([np.einsum("ij,ij->i", ua[x[k : k + PAIRS]], ub[y[k : k + PAIRS]]) >= least for k in range(0, len(x), PAIRS)] or [np.zeros(0, bool)])
                x, y = x[near], y[near]
                la, lb, before = ia.copy(), ib.copy(), -1
                while (now := int(la.sum()) + int(lb.sum())) != before:
                    before = now
                    np.minimum.at(la, x, lb[y])
                    np.minimum.at(lb, y, la[x])
                ids, least_of = np.concatenate([ia, ib]), np.concatenate([la, lb])
                linked = ids != least_of
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(least_of[linked])], ["a", "b"])

    return run


def roots(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root), root being the least node that it reaches: least label of the neighbours, then the label's label, until nothing changes."""
    both = stored(edges.union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        d = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        labels = stored(d.join(up, "root", "left").select("node", "_old", F.least("root", F.coalesce("_up", "root")).alias("root")), "labels")
        if labels.where("root <> _old").isEmpty():
            return labels.select("node", "root")
        labels = labels.drop("_old")


class _Leaders:
    """Centroids of one component as sums; they grow as rows come."""

    def __init__(self, threshold: float):
        self.threshold, self.sums, self.norms, self.first, self.size = threshold, np.zeros((4, 0)), np.zeros(4), [], []

    def place(self, i: int, v: np.ndarray) -> int:
        if not self.sums.shape[1]:
            self.sums = np.zeros((4, len(v)))
        n, own = len(self.first), float(np.sqrt(v @ v))
        if n and own:
            score = (self.sums[:n] @ v) / (self.norms[:n] * own)
            best = int(score.argmax())
            if score[best] >= self.threshold:
                self.sums[best] += v
                self.norms[best] = np.sqrt(self.sums[best] @ self.sums[best])
                self.size[best] += 1
                return self.first[best]
        if n == len(self.sums):
            self.sums, self.norms = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.norms, np.zeros(n)])
        self.sums[n], self.norms[n] = v, own or np.inf
        self.first.append(i)
        self.size.append(1)
        return i

    def clusters(self) -> Iterator[tuple[int, int, str]]:
        for k, (i, n) in enumerate(zip(self.first, self.size)):
            yield i, n, hashlib.sha256(np.round(self.sums[k] / n, 4).astype(np.float32).tobytes()).hexdigest()[:10]


def _sequential(threshold: float):
    """(root, id, vec) in order -> (id, cluster) of each row, and (null, cluster, size, slug) of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, leaders, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "cluster", "size", "slug"])

        def closed() -> None:
            if leaders:
                out.extend((None, *c) for c in leaders.clusters())

        for b in batches:
            for r, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if r != root:
                    closed()
                    root, leaders = r, _Leaders(threshold)
                out.append((i, leaders.place(i, v.values.to_numpy(zero_copy_only=False).astype(np.float64)), None, None))
                if len(out) > 20_000:
                    yield batch()
        closed()
        yield batch()

    return run


def leader_clusters(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors(id, vec) -> (id, cluster, size, slug): cluster is the id of its first row, slug a hash of its centroid."""
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    sound = F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).where(sound)
    some = F.exists("vec", lambda x: x != 0)
    one = stored(rows.where(some).groupBy("vec").agg(F.min("id").alias("node")), "vectors")
    edges = blocks_met(one.select(F.col("node").alias("id"), "vec"), BLOCK).mapInArrow(_forest(threshold * threshold - MARGIN), "a long, b long")
    label = roots(edges.distinct())
    linked = rows.where(some).join(one, "vec").join(label, "node", "left").select(F.coalesce("root", "node").alias("root"), "id", "vec")
    alone = rows.where(~some).select((-1 - F.col("id")).alias("root"), "id", "vec")  # zero vectors: no node has a negative id of theirs
    ordered = linked.union(alone).repartition("root").sortWithinPartitions("root", "id", "vec")
    placed = stored(ordered.mapInArrow(_sequential(threshold), CLUSTERS), "placed")
    about = placed.where("id is null").select("cluster", "size", "slug")
    return placed.where("id is not null").select("id", "cluster").join(about, "cluster").select("id", "cluster", "size", "slug")


def reclustered(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """C17: rows(id, vec, hit) -> (id, cluster): clusters that hold a hit, their members clustered anew; with under two such members the hits alone, without a cluster."""
    rows = stored(rows, "rows")  # vectors are computed once
    first = stored(leader_clusters(rows, threshold).join(rows.select("id", "hit"), "id"), "first")
    held = first.where("hit").select("cluster").distinct()
    members = stored(rows.select("id", "vec").join(first.join(held, "cluster", "left_semi").select("id"), "id", "left_semi"), "members")
    if len(members.select("id").limit(2).collect()) < 2:
        return rows.where("hit").select("id", F.lit(None).cast("long").alias("cluster"))
    return leader_clusters(members, threshold).select("id", "cluster")


def hybrid(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """C17: only the hits, clustered; under two of them stay as they are."""
    hits = rows.where("hit")
    if len(hits.select("id").limit(2).collect()) < 2:
        return hits.select("id", F.lit(None).cast("long").alias("cluster"))
    return reclustered(hits, threshold)
