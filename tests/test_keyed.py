"""Versioned tables: nothing doubles, two writers, and writers that die."""

import threading

import pytest
from pyspark.sql import functions as F

from sessionloom.sources.keyed import KeyedTable

ROW = "k string, n long, v string"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ("k", "n"), 4)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_twice_doubles_nothing(spark, store):
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), (None, 1, "x"), ("a", 1, "x")], ROW)
    assert store.version() == 0
    assert store.insert_new(first) == 1 and store.insert_new(first) == 1
    assert store.insert_new(spark.createDataFrame([("a", 1, "other"), ("b", None, "new"), (None, 1, "other")], ROW)) == 2
    assert content(store.read()) == [("a", 1, "x"), ("a", 2, "x"), ("b", None, "new"), (None, 1, "x")]
    assert store.read(1).count() == 3


def test_merge_replaces_and_leaves_other_buckets(spark, store):
    store.merge(spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("n"), F.lit("old").alias("v")))
    before = store._manifest(1)["parts"][0]
    store.merge(spark.createDataFrame([("a", 7, "new"), ("z", None, "z")], ROW))
    kept = next(p for p in store._manifest(2)["parts"] if p["name"] == before["name"])
    assert kept["buckets"] and set(kept["buckets"]) < set(before["buckets"])
    got = {(r["k"], r["n"]): r["v"] for r in store.read().collect()}
    assert len(got) == store.read().count() == 201 and got["a", 7] == "new" and got["z", None] == "z" and got["a", 8] == "old"
    assert store.read(1).where("v <> 'old'").count() == 0
    assert store.merge(spark.createDataFrame([], ROW)) == 2


def test_empty_and_wrong_rows(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.insert_new(spark.createDataFrame([], ROW)) == 1 and store.read().collect() == []
    store.insert_new(spark.createDataFrame([("a", 1, "x")], ROW))
    with pytest.raises(ValueError):
        store.insert_new(spark.createDataFrame([("a", 1)], "k string, n long"))
    with pytest.raises(ValueError):
        KeyedTable(spark, store.path, ("k",)).insert_new(spark.createDataFrame([("a", 1, "x")], ROW))


def test_a_dead_writer_leaves_the_old_version(spark, store, monkeypatch):
    store.insert_new(spark.createDataFrame([("a", 1, "x")], ROW))

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_published", dies)
    with pytest.raises(RuntimeError):
        store.insert_new(spark.createDataFrame([("b", 1, "x")], ROW))
    monkeypatch.undo()
    assert content(store.read()) == [("a", 1, "x")]
    store.insert_new(spark.createDataFrame([("b", 1, "y")], ROW))
    assert content(store.read()) == [("a", 1, "x"), ("b", 1, "y")]


def test_two_writers_at_once(spark, store):
    rows = [spark.createDataFrame([("a", n, str(w)) for n in range(w, 20 + w)], ROW) for w in range(3)]
    threads = [threading.Thread(target=store.insert_new if w else store.merge, args=(r,)) for w, r in enumerate(rows)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = [r["n"] for r in store.read().collect()]
    assert sorted(got) == list(range(22)) and store.version() >= 2


def test_a_taken_number_is_not_overwritten(spark, store):
    store.insert_new(spark.createDataFrame([("a", 1, "x")], ROW))
    assert not store._published(1, {}) and content(store.read()) == [("a", 1, "x")]
