"""Near vectors through hashed bands against all pairs; vectors of shingles against a plain count."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import neighbours as o


def planted(rng, groups, each, dim, noise):
    centres = rng.normal(size=(groups, dim))
    return [c + rng.normal(size=dim) * noise for c in centres for _ in range(each)]


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<float>").repartition(3)


def all_pairs(vectors, least):
    v = np.asarray(vectors, np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)))}


@pytest.mark.parametrize(("cell", "block"), [(64, 8192), (64, 24), (4, 100)])
def test_recall_and_no_pair_twice(spark, monkeypatch, cell, block):
    """Cells that hold one block and cells cut into many give the same pairs; each comes once and is a true one."""
    monkeypatch.setattr(o, "BLOCK", block)
    vectors = planted(np.random.default_rng(5), 90, 5, 24, 0.42)
    got = [r for r in o.near_pairs(frame(spark, vectors), cell=cell).collect() if not r["equal"]]
    want = all_pairs(vectors, 0.85)
    pairs = {(r["a"], r["b"]) for r in got}
    assert len(pairs) == len(got) and pairs <= want and len(want) > 300
    assert len(pairs) >= 0.95 * len(want)
    at = next(iter(got))
    a, b = (np.asarray(vectors[at[k]], np.float32).astype(float) for k in "ab")
    assert at["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-5)


def test_recall_just_above_the_threshold(spark):
    """Pairs at a cosine of 0.85 to 0.87 are found as often as asked; few others meet."""
    rng, vectors = np.random.default_rng(6), []
    for _ in range(600):
        a, b = rng.normal(size=(2, 48))
        a, b = a / np.linalg.norm(a), b - (b @ a) / (a @ a) * a
        vectors += [a, 0.86 * a + np.sqrt(1 - 0.86**2) * b / np.linalg.norm(b)]
    got = {(r["a"], r["b"]) for r in o.near_pairs(frame(spark, vectors), cell=16).collect()}
    want = all_pairs(vectors, 0.85)
    assert got <= want and len(got) >= 0.95 * len(want)


def test_banding_keeps_recall_and_grows_slowly():
    for rows in (10, 10**4, 10**6, 10**9):
        bits, bands = o.banding(rows, 0.85, 0.95)
        alike = 1 - np.arccos(0.85) / np.pi
        assert 1 - (1 - alike**bits) ** bands >= 0.95 and rows / 2**bits <= o.CELL
    small, large = o.banding(10**6, 0.85, 0.95)[1], o.banding(10**9, 0.85, 0.95)[1]
    assert large < small * 1000**0.3


def test_copies_and_odd_rows(spark):
    near, other = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    vectors = [near, [1.0, 0.05, 0.2], near, other, None, [0.0] * 3, [1.0, None, 0.0], [float("nan"), 1.0, 1.0], [1.0, 0.0], [], near]
    pairs = o.near_pairs(frame(spark, vectors), recall=0.9999)
    got = {(r["a"], r["b"], r["copies_a"], r["copies_b"], r["equal"]) for r in pairs.collect()}
    assert got == {(0, 1, 3, 1, False), (0, 2, 3, 3, True), (0, 10, 3, 3, True)}
    links = {tuple(r) for r in o.near_links(frame(spark, vectors), recall=0.9999).collect()}
    assert links == {(0, 0, 3), (2, 0, 3), (10, 0, 3), (1, 1, 3), (3, 3, 0), (8, 8, 0)}
    assert o.near_pairs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        o.near_pairs(frame(spark, vectors), 1.0)


def test_one_group_of_near_copies(spark, monkeypatch):
    """Every vector near every other one: all links are there, through blocks."""
    monkeypatch.setattr(o, "BLOCK", 16)
    rng = np.random.default_rng(7)
    vectors = [np.ones(32) + rng.normal(size=32) * 0.05 for _ in range(150)]
    assert o.near_pairs(frame(spark, vectors)).count() == 150 * 149 // 2
    assert {r["links"] for r in o.near_links(frame(spark, vectors)).collect()} == {149}


def test_text_vectors(spark):
    words = "the quick brown fox jumps over the quick brown fox again and again"
    d = spark.createDataFrame([(1, words), (2, words + " now"), (3, None), (4, "two words"), (5, "")], "id int, text string").repartition(2)
    got = {r["id"]: r["vec"] for r in o.text_vectors(d, "id", "text").collect()}
    grams = [tuple(words.split()[i : i + 3]) for i in range(len(words.split()) - 2)]
    places = [r[0] for r in spark.createDataFrame([(list(g),) for g in grams], "g array<string>").select(F.pmod(F.xxhash64("g"), F.lit(128))).collect()]
    want = np.zeros(64)
    for p in places:
        want[p % 64] += 1 if p >= 64 else -1
    assert got[1] == list(want)
    assert got[3] == got[4] == got[5] == [0.0] * 64
    assert sum(abs(x - y) for x, y in zip(got[1], got[2])) == 1
