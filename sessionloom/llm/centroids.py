"""Centroid clustering in exact integers, with bounds loosened by the norm of sums.

Every vector keeps, for each centroid, a lower bound of its distance and the
round in which that was measured, and an upper bound of the distance to its own
centroid.  All centroids of all rounds so far are kept as well, so a bound is
loosened by the norm of the centroid's whole displacement since the bound was
measured, |c(t) - c(s)|, and not by the sum of the drifts of the rounds between,
which is never less.  Where a loosened lower bound doesn't exceed the upper one,
both distances are measured anew in integers; so results are those of plain
assignment, ties included.

The state of a round is a table in the shared folder, which the next round
reads: a lost executor costs tasks of one round.  The driver holds the
centroids alone (number of clusters x components x rounds).

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; a null id counts as the empty text in the
hash; repeated rows are vectors of their own, and equal hashes are ordered by
components; with fewer vectors than centroids there are as many centroids as
vectors; an empty table gives an empty result; extra columns are ignored.  A
component of 2^19 or more stops the run, as distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, stored, table, tune

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 40, 5, 64, 256
#: Integers of a component stay below this, so that a squared distance fits a long.
MOST = 1 << 27
#: Rounding of square roots and sums is less than this share.
SLACK = 1e-12
STATE = "vec_id long, x binary, cluster int, upper double, upper_at int, lower binary, lower_at binary, n_exact long"


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, x): x holds floor(scale * component) as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(v), components), False))
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, components)
            whole = np.isfinite(x).all(axis=1)  # a null has become NaN
            x = np.floor(scale * x[whole])
            if x.size and np.abs(x).max() >= MOST:
                raise ValueError(f"a component of {np.abs(x).max() / scale} is too large for exact distances")
            rows = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(whole)), pa.array(rows, pa.binary())], ["vec_id", "x"])

    tune(vectors.sparkSession)
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, x binary")


def first_centroids(rows: DataFrame, k: int = CLUSTERS, seed: str = "2") -> np.ndarray:
    """The k vectors of least sha256 of ``seed:vec_id``, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in got], np.int64).reshape(len(got), -1 if got else 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to c, or to its row of c, exactly."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly."""
    bound = int(np.abs(x).max(initial=0)) * int(np.abs(c).max(initial=0)) * x.shape[1]
    if bound < 1 << 52:  # products are exact in doubles
        dot = np.rint(x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        own = x.astype(np.int64)
        return np.einsum("ij,ij->i", own, own)[:, None] - 2 * dot + np.einsum("ij,ij->i", c, c)
    return np.stack([squared(x, row) for row in c], axis=1)


def displacement(history: list[np.ndarray]) -> np.ndarray:
    """[s, j]: how far centroid j is now from where it was in round s, rounded up."""
    now = history[-1]
    return np.sqrt(np.array([((now - c) ** 2).sum(axis=1) for c in history], np.float64)) * (1 + SLACK)


def _floor(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype("<f4"), np.float32(-np.inf))


def _ceiling(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


class Bounds:
    """The state of a batch of vectors: own centroid, upper bound, lower bounds, and when each was measured."""

    def __init__(self, x: np.ndarray, history: list[np.ndarray]):
        d = all_squared(x, history[0])
        self.x, self.cluster = x, d.argmin(axis=1)  # the first of equals
        self.upper = _ceiling(d[np.arange(len(x)), self.cluster])
        self.upper_at = np.zeros(len(x), np.int32)
        self.lower, self.lower_at = _floor(d), np.zeros(d.shape, np.uint8)
        self.exact = np.full(len(x), d.shape[1], np.int64)

    def assign(self, history: list[np.ndarray]) -> None:
        """Nearest of the newest centroids; only pairs whose bounds leave it open are measured."""
        t, now, moved = len(history) - 1, history[-1], displacement(history)
        each = np.arange(len(self.x))
        low = self.lower - moved[self.lower_at, np.arange(len(now))]
        low[each, self.cluster] = np.inf
        rows = np.flatnonzero(low.min(axis=1, initial=np.inf) <= self.upper + moved[self.upper_at, self.cluster])
        x, own = self.x[rows], self.cluster[rows]
        best, where = squared(x, now[own]), own.copy()
        self._measured(rows, own, best, t)
        open_ = low[rows] <= _ceiling(best)[:, None]
        for j in np.flatnonzero(open_.any(axis=0)):
            r = np.flatnonzero(open_[:, j])
            d = squared(x[r], now[j])
            self._measured(rows[r], j, d, t)
            nearer = (d < best[r]) | ((d == best[r]) & (j < where[r]))
            best[r[nearer]], where[r[nearer]] = d[nearer], j
        self.cluster[rows], self.upper[rows], self.upper_at[rows] = where, _ceiling(best), t

    def _measured(self, rows: np.ndarray, j, squares: np.ndarray, t: int) -> None:
        self.lower[rows, j], self.lower_at[rows, j] = _floor(squares), t
        self.exact[rows] += 1

    @classmethod
    def read(cls, b: pa.RecordBatch, d: int, k: int) -> Bounds:
        self = cls.__new__(cls)
        flat = lambda name, kind, width: np.frombuffer(bytearray().join(b.column(name).to_pylist()), kind).reshape(-1, width).copy()
        plain = lambda name: b.column(name).to_numpy(zero_copy_only=False).copy()
        self.x, self.lower, self.lower_at = flat("x", "<i4", d), flat("lower", "<f4", k), flat("lower_at", np.uint8, k)
        self.cluster, self.upper, self.upper_at, self.exact = plain("cluster").astype(np.int64), plain("upper"), plain("upper_at"), plain("n_exact")
        return self

    def written(self, ids: pa.Array) -> pa.RecordBatch:
        of = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays(
            [ids, of(self.x), pa.array(self.cluster, pa.int32()), pa.array(self.upper), pa.array(self.upper_at, pa.int32()), of(self.lower), of(self.lower_at), pa.array(self.exact, pa.int64())],
            ["vec_id", "x", "cluster", "upper", "upper_at", "lower", "lower_at", "n_exact"],
        )


def started(rows: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """(vec_id, x) -> the state after the first assignment."""
    d = history[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(bytearray().join(b.column(1).to_pylist()), "<i4").reshape(-1, d)
            yield Bounds(x, history).written(b.column(0))

    return rows.mapInArrow(run, STATE)


def assigned(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The state of the round before -> the state with the newest centroids."""
    k, d = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = Bounds.read(b, d, k)
            bounds.assign(history)
            yield bounds.written(b.column("vec_id"))

    return state.mapInArrow(run, STATE)


def measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The last state -> (vec_id, cluster, distance, n_exact)."""
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, c = np.frombuffer(bytearray().join(b.column(1).to_pylist()), "<i4").reshape(-1, d), b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(squared(x, centroids[c]), pa.int64()), b.column(3)], ["vec_id", "cluster", "distance", "n_exact"])

    return state.select("vec_id", "x", "cluster", "n_exact").mapInArrow(run, "vec_id long, cluster int, distance long, n_exact long")


def moved(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """The next centroids: floor(sum / count) of each non-empty cluster; sums are made in tasks and added in a shuffle of k x d keys."""
    k, d = before.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for b in batches:
            x, c = np.frombuffer(bytearray().join(b.column(1).to_pylist()), "<i4").reshape(-1, d), b.column(0).to_numpy()
            n += np.bincount(c, minlength=k)
            for j in np.unique(c):
                total[j] += x[c == j].sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    out = before.copy()
    for r in sums.collect():
        out[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: str = "2") -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, embedding) -> ((vec_id, cluster, distance, n_exact), final centroids).

    n_exact counts the distances measured for the vector in all rounds; plain
    assignment measures k * (rounds + 1).  The returned frame reads one table
    of the shared folder; the others are deleted.
    """
    rows = integers(vectors, components, scale)
    history = [first_centroids(rows, k, seed)]
    if not len(history[0]):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("n_exact")).where("false"), history[0]
    over: list[str] = []
    state = stored(started(rows, history), "centroid-state", over)
    for _ in range(rounds):
        history.append(moved(state, history[-1]))
        before, over = over, []
        state = stored(assigned(state, history), "centroid-state", over)
        dropped(before)
    out = stored(measured(state, history[-1]), "clusters")
    dropped(over)
    return out, history[-1]


def described(assignment: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Beside each vector: inertia of its cluster and of all, and the sha256 of its centroid."""
    spark = assignment.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in assignment.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(j, sums.get(j, 0), sum(sums.values()), h) for j, h in enumerate(hashes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assignment.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*clusters(table(spark, sf_dir, "embeddings")))


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT row, min({{'d': d, 'j': j}}) AS m FROM (SELECT row, j, {square}::BIGINT AS d FROM v, c{t} AS c) GROUP BY row)")
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (SELECT j, coalesce(any_value(n.x), any_value(c.x)) AS x FROM c{t} AS c LEFT JOIN (
                SELECT j, list({floor} ORDER BY i) AS x FROM (SELECT m.j AS j, i, sum(v.x[i]) AS s, count(*) AS n FROM a{t} JOIN v USING (row), range(1, 65) AS r(i) GROUP BY m.j, i) GROUP BY j) AS n USING (j) GROUP BY j)"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
           sha256(list_aggregate(c.x, 'string_agg', ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (row) JOIN c{rounds} AS c ON c.j = m.j"""


ORACLE = _oracle()
