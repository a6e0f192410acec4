"""Forward windows found by time, and trends by bucket, on literal rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import review, timeseries

T = datetime(2024, 3, 1, 12)
ROW = "session_id long, id long, ts timestamp_ntz, role string, tool_name string, tool_input string, output string, error string, content string"


def at(s):
    return T + timedelta(seconds=s)


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([
        (1, 1, at(0), "assistant", "Bash", "ls", None, "no\nfile", None), (1, 2, at(0), "assistant", "Read", "a", "text", None, None), (1, 3, at(5), "user", None, None, None, None, "  try\nagain "),
        (1, 4, at(9), "assistant", "Edit", None, "", "", None), (1, 5, at(9), "user", None, None, None, None, "  "), (2, 6, at(3), "user", None, None, None, None, "other"),
    ], ROW)


def test_anchors_are_located(spark, turns):
    asked = [(10, 1, at(0), "Read", 2), (11, 1, at(0), "Grep", 1), (12, 1, at(0), None, 1), (13, 1, at(1), "Bash", 3), (14, 1, at(9), "Edit", 4), (15, 1, at(10), "Edit", None), (16, 3, at(0), "Bash", None), (17, 1, at(-60), "Edit", 1), (18, 2, None, None, 6)]
    anchors = spark.createDataFrame([a[:4] for a in asked], "anchor_id long, session_id long, anchor_ts timestamp_ntz, tool_name string")
    assert {r["anchor_id"]: r["row_id"] for r in review.located(anchors, turns).collect()} == {a[0]: a[4] for a in asked}


def test_windows_say_how_calls_ended(spark, turns):
    anchors = spark.createDataFrame([(1, 1, at(-5), None), (2, 1, at(9), "Edit"), (3, 9, at(0), None)], "anchor_id long, session_id long, anchor_ts timestamp_ntz, tool_name string")
    got = {r["anchor_id"]: r["following"] for r in review.located_windows(anchors, turns, 3).collect()}
    assert got == {1: "[assistant/Read/OK] a → text\n[user] try again\n[assistant/Edit/OK]  → ", 2: "", 3: ""}
    failed = {r["id"]: r["line"] for r in turns.withColumn("line", review.turn_text(turns)).collect()}
    assert failed[1] == "[assistant/Bash/ERR] ls → no file" and failed[5] is None
    assert review.located_windows(anchors, turns, 3, 10).where("anchor_id = 1").first()["following"] == "[assistant"


@pytest.mark.parametrize(("unit", "names"), [("day", ["2024-03-02", "2024-03-11"]), ("week", ["2024-W09", "2024-W11"]), ("month", ["2024-02", "2024-03"])])
def test_trend_table(spark, unit, names):
    days = [(2024, 2, 28, "a"), (2024, 3, 1, "a"), (2024, 3, 2, "a"), (2024, 3, 2, "b"), (2024, 3, 11, "b"), (2024, 3, 11, "b"), (2024, 3, 11, "c")]
    rows = spark.createDataFrame([(datetime(*d[:3]), d[3]) for d in days] + [(None, "a")], "ts timestamp_ntz, kind string")
    wide, got = timeseries.trend_table(rows, "kind", unit, 2, 2)
    assert got == names
    table = {r["kind"]: (r["rank"], r[names[0]], r[names[1]], r["total"], r["delta"], r["arrow"]) for r in wide.collect()}
    want = {
        "day": {"b": (1, 1, 2, 3, 1, "up"), "a": (2, 1, 0, 1, -1, "down")}, "week": {"a": (1, 3, 0, 3, -3, "down"), "b": (2, 1, 2, 3, 1, "up")},
        "month": {"a": (1, 1, 2, 3, 1, "up"), "b": (2, 0, 3, 3, 3, "up")},
    }
    assert table == want[unit]
    one, names = timeseries.trend_table(rows.where("kind = 'c'"), "kind", unit, 4, 2)
    assert len(names) == 1 and one.first()["arrow"] is None
    none, names = timeseries.trend_table(rows.where(F.lit(False)), "kind", unit, 4, 2)
    assert not names and none.collect() == []


def test_cohort_report_meets_suggestions_by_their_patterns(spark):
    """a suggestion of two patterns counts once for a window, and none meets a window by itself."""
    from sessionloom.operators import progress

    runs = spark.createDataFrame([("x", T, at(3600), at(-7200), T), ("y", at(7200), at(9000), T, at(7200))], "name string, lo timestamp_ntz, hi timestamp_ntz, base_lo timestamp_ntz, base_hi timestamp_ntz")
    errors = spark.createDataFrame([(at(10), "p", 1), (at(20), "q", 2), (at(-10), "p", 3), (at(8000), "q", 2), (at(8100), "q", 4)], "ts timestamp_ntz, kind string, pattern_id long")
    given = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3), (4, 2), (4, 2), (5, None), (None, 2)], "suggestion_id long, pattern_id long")
    d = progress.cohort_report(runs, errors, "kind", given)
    assert {(r["name"], r["errors"], r["base_errors"], r["new_kinds"], r["suggestions"]) for r in d.collect()} == {("x", 2, 1, 1, 3), ("y", 2, 2, 0, 3)}
    assert "distinct suggestion_id" not in d._jdf.queryExecution().analyzed().toString()
