"""Leader clustering over all rows against the sequential rule, and clustering anew around hits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import leader


def sequential(rows, threshold):
    """rows(id, vec) -> {id: first id of its cluster}; the rule itself, row after row, with means as centroids."""
    centroids, first, size, out = [], [], [], {}
    for i, v in sorted(rows, key=lambda r: (r[0], list(r[1]))):
        v, best, at = np.asarray(v, np.float32).astype(float), -1.0, None
        for k, c in enumerate(centroids):
            length = np.linalg.norm(c) * np.linalg.norm(v)
            sim = float(c @ v / length) if length else 0.0
            if sim >= threshold and sim > best:
                best, at = sim, k
        if at is None:
            centroids.append(v.copy())
            first.append(i)
            size.append(1)
            at = len(first) - 1
        else:
            size[at] += 1
            centroids[at] = (centroids[at] * (size[at] - 1) + v) / size[at]
        out[i] = first[at]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, vec array<float>").repartition(3)


@pytest.mark.parametrize(("threshold", "spread"), [(0.7, 0.5), (0.9, 0.25), (0.5, 2.0)])
def test_equals_the_sequential_rule(spark, monkeypatch, threshold, spread):
    monkeypatch.setattr(leader, "BLOCK", 40)  # several blocks
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * spread) * rng.uniform(0.1, 10)) for i in range(240)]
    rows += [(300 + i, rows[i][1]) for i in range(5)] + [(400, np.zeros(6)), (401, np.zeros(6))]
    got = leader.leader_clusters(frame(spark, [*rows, (500, None), (501, [1, None, 1, 1, 1, 1]), (502, [float("nan")] * 6)]), threshold).collect()
    want = sequential(rows, threshold)
    assert len(got) == len(rows) and {r["id"]: r["cluster"] for r in got} == want
    sizes = {c: list(want.values()).count(c) for c in want.values()}
    assert all(r["size"] == sizes[r["cluster"]] for r in got) and len({r["slug"] for r in got}) == len(sizes) - 1  # two zero vectors have one slug


def test_no_vectors(spark):
    assert leader.leader_clusters(frame(spark, []), 0.8).collect() == []


def test_roots_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    got = {r["node"]: r["root"] for r in leader.roots(chain).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 500: 400}


def test_reclustered(spark):
    near = [(1, [1, 0, 0]), (2, [1, 0.1, 0]), (3, [0, 1, 0]), (4, [0, 1, 0.1]), (5, [0, 0, 1])]
    rows = lambda *hits: frame(spark, near).withColumn("hit", leader.F.col("id").isin(*hits))
    as_set = lambda d: {(r["id"], r["cluster"]) for r in d.collect()}
    assert as_set(leader.reclustered(rows(2))) == {(1, 1), (2, 1)}, "the whole cluster of a hit"
    assert as_set(leader.reclustered(rows(1, 4))) == {(1, 1), (2, 1), (3, 3), (4, 3)}
    assert as_set(leader.reclustered(rows(5))) == {(5, None)}, "under two rows: the hits as they are"
    assert as_set(leader.reclustered(rows(9))) == set()
    assert as_set(leader.hybrid(rows(2))) == {(2, None)}
    assert as_set(leader.hybrid(rows(1, 2, 4))) == {(1, 1), (2, 1), (4, 4)}


def test_vectors_are_computed_once(spark):
    """words are hashed once for a vector, and a vector once for all passes."""
    from sessionloom.operators.exports import word_vector

    d = spark.createDataFrame([(1, "Ab ab cd"), (2, None), (3, "")], "id long, text string").select("id", word_vector(F.col("text")).alias("vec"))
    assert sum(d.where("id = 1").first()["vec"]) == 3 and d.where("id > 1").select("vec").distinct().first()["vec"] == [0.0] * 16
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>").withColumn("vec", F.udf(counted, "array<double>")("v")).withColumn("hit", F.col("id") == 1)
    assert {tuple(r) for r in leader.reclustered(rows.drop("v")).collect()} == {(1, 1), (2, 1)}
    assert calls.value == 3
