"""Operators of the curation module: what SQL cannot express, and boundary rows."""

import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import curation as o


def test_rule_blocks(spark):
    text = "# One\na\nb\n\n\n  \n## Two\n### Three\nc"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_line"], r["block"]) for r in o.rule_blocks(d).collect())
    assert got == [(1, 1, "# One\na\nb"), (1, 7, "## Two"), (1, 8, "### Three\nc"), (4, 1, "x")]


def test_line_budget(spark):
    d = spark.createDataFrame([("a\n\n<!-- b\nc -->\nd",), (None,), ("1\n2\n3",), ("1\n2\n3\n4",)], "t string")
    assert sorted((r["n_lines"], r["status"]) for r in o.line_budget(d, "t", 2, 4).collect()) == [(0, "ok"), (2, "ok"), (3, "consolidate"), (4, "blocked")]


def test_merged_text(spark):
    d = spark.createDataFrame([("a\nb\nlong line", " b\nc"), ("x", "y"), ("same", "same")], "a string, b string")
    assert [r[0] for r in d.select(o.merged_text(F.col("a"), F.col("b"))).collect()] == ["a\nb\nlong line\nc", "x\ny", "same"]


def test_consolidation_ends_without_near_pairs(spark):
    rows = [("f", 1, "never push to main"), ("f", 2, "never push to main branch"), ("f", 3, "use small functions"), ("g", 1, "alone"), ("g", 2, None)]
    got = {(r["f"], r["id"]): r["text"] for r in o.consolidated(spark.createDataFrame(rows, "f string, id long, text string"), "f", 0.8).collect()}
    assert got == {("f", 2): "never push to main branch\nnever push to main", ("f", 3): "use small functions", ("g", 1): "alone", ("g", 2): ""}


@pytest.mark.parametrize(("n", "least", "words"), [(60, 0.8, 5), (90, 0.5, 6), (700, 0.9, 4)])
def test_consolidation_equals_the_whole_matrix_anew(spark, n, least, words):
    rng = np.random.default_rng(n)
    texts = [" ".join(rng.choice(list("abcdefghijkl"), words)) for _ in range(n)]
    got = {r["id"]: r["text"] for r in o.consolidated(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "f string, id long, text string"), "f", least).collect()}
    left, merges = dict(enumerate(texts)), 0
    bags = {i: o._bag(t) for i, t in left.items()}
    while True:
        ids = sorted(left)
        v = np.stack([bags[i] for i in ids])
        length = np.sqrt((v * v).sum(axis=1))
        s = np.triu(v @ v.T / (length[:, None] * length), 1)
        if s.max() < least:
            break
        a, b = (ids[k] for k in np.unravel_index(s.argmax(), s.shape))
        keep, drop = (a, b) if len(left[a]) >= len(left[b]) else (b, a)
        lines = left[keep].split("\n")
        left[keep] = "\n".join([*lines, *(x for x in left[drop].split("\n") if x.strip() and x not in lines)])
        bags[keep] = o._bag(left[keep])
        del left[drop], bags[drop]
        merges += 1
    assert merges > 5 and got == left


def test_drift_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("abc "), 12)), "".join(rng.choice(list("abc "), 12))) for _ in range(40)] + [(None, None), ("", "a"), ("same", "same")]
    for r in o.drift(spark.createDataFrame(rows, "a string, b string")).collect():
        want = difflib.SequenceMatcher(None, r["a"] or "", r["b"] or "").ratio()
        assert (r["ratio"], r["collision"], r["needs_approval"]) == (want, want >= 0.85, 1 - want >= 0.40)


def test_gold_replay_edges(spark):
    d = spark.createDataFrame([("", "x"), ("a b c d", "A"), ("a b c", "c z"), ("a", None)], "gold string, prompt string")
    assert [(r["overlap"], r["passes"]) for r in o.gold_replay(d).collect()] == [(None, True), (0.25, False), (1 / 3, True), (0.0, False)]


def test_quality(spark):
    rows = [("undo", "Bash", "failed commit", "Run `git status` and check /tmp/x, then set settings"), ("odd", "mcp_tool", "", "mcp"), ("undo", "t", "word", None)]
    got = o.quality(spark.createDataFrame(rows, "error_type string, tool string, errors string, rule string")).collect()
    assert (got[0]["actionability"], got[0]["surface"]) == (1.0, 1.0) and got[1]["surface"] == 1.0 and (got[2]["specificity"], got[2]["surface"]) == (0.0, 1.0)


def test_search_feedback_window(spark):
    rows = [(1, "s", "search", "2024-01-01 00:00:00"), (2, "s", "shell", "2024-01-01 00:05:00"), (3, "s", "say", "2024-01-01 00:15:00"), (4, "s", "say", "2024-01-01 00:15:01"), (5, "t", "say", "2024-01-01 00:00:00")]
    d = spark.createDataFrame(rows, "id long, session_id string, tool string, t string").withColumn("ts", F.to_timestamp_ntz("t"))
    args = (F.col("tool").isin("search", "shell"), F.col("tool") == "search", F.col("tool") == "say")
    assert [(r["id"], r["search_id"]) for r in o.search_feedback(d, *args).collect()] == [(3, 1)]
    assert o.search_feedback(d, *args, last=1).count() == 0


def test_slug_remap_ties_and_misses(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "slug string, member long")
    new = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "slug string, member long")
    assert sorted(map(tuple, o.slug_remap(old, new).collect())) == [("a", "y", 0.5), ("b", None, None)]


def test_diversity_keeps_the_best(spark):
    rows = [(1, "g", 0.9, [1.0, 0.0]), (2, "g", 0.8, [0.99, 0.01]), (3, "g", 0.7, [0.0, 1.0]), (4, "h", 0.1, [1.0, 0.0]), (5, "h", 0.1, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, g string, score double, vec array<double>")
    assert sorted(r["id"] for r in o.diversity(d, "g").collect()) == [1, 3, 4]


@pytest.mark.parametrize("least", [0.6, 0.9])
def test_diversity_like_the_sequential_rule(spark, least):
    """Equal vectors within and across groups, ties of scores, null groups and zero vectors."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 4)).astype(np.float32)
    rows = [(i, (None, "g", "h")[i % 3], float(round(rng.random(), 1)), [float(x) for x in base[rng.integers(40)] * (i % 17 > 0)]) for i in range(300)]
    want = []
    for g in (None, "g", "h"):
        kept = []
        for i, _, score, v in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0])):
            v = np.array(v) / max(np.linalg.norm(v), 1e-12)
            if not any(v @ k >= least for k in kept):
                kept.append(v)
                want.append((i, g, score))
    got = o.diversity(spark.createDataFrame(rows, "id long, g string, score double, vec array<double>"), "g", least).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert o.rule_blocks(none).count() == o.snippets(none, "source", 3).count() == o.registry(none, "text", "doc_id").count() == 0


def test_accumulated_deals_rows_by_id_before_patterns_multiply_them(spark):
    """examples of a tool's patterns, kept ones first; a row of an unknown tool is in none."""
    old = spark.createDataFrame([(1, 10, 1), (1, 11, 0), (None, 12, 1)], "pattern_id int, id long, label int")
    new = spark.createDataFrame([(11, "a", 1), (13, "a", 1), (14, "b", 0), (15, None, 1), (16, "z", 1)], "id long, tool string, label int")
    patterns = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "pattern_id int, tool string")
    d = o.accumulated(old, new, patterns, 2)
    assert {tuple(r) for r in d.collect()} == {(1, 2, 1, 2, 3, False), (2, 2, 0, 0, 2, True), (None, 1, 0, 1, 1, False)}
    assert "RepartitionByExpression [id" in d._jdf.queryExecution().optimizedPlan().toString()
