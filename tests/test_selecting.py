"""Curation, promotion, clusters, flows, health, frictions and datasets on literal rows and against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from sessionloom.operators import selecting as o

T = datetime(2024, 3, 1, 12)
ERROR = "id long, session_id string, ts timestamp_ntz, tool_name string, tool_input string, error_text string, user_message string, error_type string, pattern_id string, source_file string"


def at(s):
    return None if s is None else T + timedelta(seconds=s)


def error(i, s=0, tool="Bash", text="boom", message=None, kind="tool_failure", pattern="p-1", file="f", session="s", value=None):
    return (i, session, at(s), tool, value, text, message, kind, pattern, file)


def ids(df, name="id"):
    return sorted(r[name] for r in df.collect())


@pytest.fixture(scope="module")
def errors(spark):
    return spark.createDataFrame([
        error(1), error(2, 10, message="why??"), error(3, 20, message="stop!!", kind="undo", pattern=None), error(4, 30, kind="user_correction"), error(5, 40, pattern="big-Cascade-2"), error(6, 50, pattern=""),
        error(7, 60, pattern="P-2", message="fine!"), error(8, None, message="?!"), error(9, 70, kind=None), error(10, 80, file=None),
    ], ERROR)


@pytest.mark.parametrize(("filters", "kept"), [
    ({}, [1, 2, 3, 6, 7, 8, 10]), ({"exclude_corrections": False}, [1, 2, 3, 4, 6, 7, 8, 9, 10]), ({"exclude_cascade": False}, [1, 2, 3, 5, 6, 7, 8, 10]), ({"since": "2024-03-01 12:00:50"}, [6, 7, 10]),
    ({"emphasis": True}, [2, 3]), ({"classified": True}, [1, 2, 7, 8, 10]), ({"pattern": "p-1"}, [1, 2, 8, 10]), ({"pattern_prefix": "p-"}, [1, 2, 7, 8, 10]), ({"error_types": ("undo", "user_correction")}, [3]),
    ({"emphasis": True, "classified": True}, [2]),
])
def test_each_filter_by_itself_and_together(errors, filters, kept):
    assert ids(o.curated(errors, o.Filters(**filters))) == kept


def test_curation_needs_positives_and_keeps_columns(spark, errors):
    with pytest.raises(ValueError):
        o.curated(errors, o.Filters(recovered_within=600))
    none = spark.createDataFrame([], "ts timestamp_ntz, source_file string")
    assert o.curated(errors, o.Filters(recovered_within=600), none).collect() == []
    odd = errors.withColumn("lo", errors.id).withColumn("hi", errors.id)
    some = spark.createDataFrame([(at(25), "f"), (None, "f"), (at(90), None)], "ts timestamp_ntz, source_file string")
    got = o.curated(odd, o.Filters(recovered_within=10), some)
    assert got.columns == odd.columns and ids(got) == [3]


def test_recovery_equals_a_loop_over_pairs(spark):
    r = random.Random(3)
    e = [error(i, r.randrange(400), file=f"f{r.randrange(3)}") for i in range(150)]
    p = [(at(r.randrange(400)), f"f{r.randrange(3)}") for _ in range(25)]
    errors, positives = spark.createDataFrame(e, ERROR), spark.createDataFrame(p, "ts timestamp_ntz, source_file string")
    for width in (3, 7, 30):
        want = sorted(x[0] for x in e if any(f == x[9] and 0 < (ts - x[2]).total_seconds() < width for ts, f in p))
        assert want and ids(o.recovered(errors, positives, width)) == want


def test_promotions(spark):
    errors = spark.createDataFrame([error(1, 0), error(2, 0, pattern="waits"), error(3, 599, pattern=None), error(4, 600), error(5, 100, file="g"), error(6, -1), error(7, None)], ERROR)
    row = "id long, ts timestamp_ntz, source_file string, kind string, sentiment double"
    positives = spark.createDataFrame([(10, at(600), "f", "confirmation", None), (11, at(599), "f", "session_success", 0.5), (12, at(10), "f", "gratitude", 1.0), (13, at(10), "f", "implicit_approval", 0.2), (14, at(10), None, "confirmation", 1.0)], row)
    truths = spark.createDataFrame([("waits", "pending", "positive_record"), ("waits", "pending", "positive_record"), ("p-1", "positive", "positive_record"), ("p-1", "pending", "other"), (None, "pending", "positive_record")], "pattern_id string, label string, source string")
    pairs = lambda *a: sorted((r["positive_id"], r["error_id"]) for r in o.promotions(positives, errors, truths, *a).collect())
    assert pairs(0.5) == [(10, 3), (11, 1)]
    assert pairs(0.0) == [(10, 3), (11, 1), (13, 1), (13, 6)]
    assert pairs(0.5, "2024-03-01 12:10:00") == [(10, 3)]


def test_positive_records_ask_for_a_tool(spark):
    row = "id long, session_id long, ts timestamp_ntz, role string, tool_name string, content string, source_file string"
    turns = spark.createDataFrame([
        (1, 1, at(0), "user", None, "great", "f"), (2, 1, at(1), "assistant", None, "x" * 300, "f"), (3, 1, at(2), "user", None, "great", "f"), (4, 1, at(3), "assistant", "Edit", None, "f"), (5, 1, at(4), "human", None, "great", "f"),
        (6, 1, at(5), "user", None, "great " * 20, "f"), (7, 1, at(6), "user", None, "great but wrong", "f"), (8, 1, at(7), "user", None, "thank you", "f"), (9, 1, at(8), "user", None, "  ", "f"), (10, 2, at(9), "user", None, "yes exactly", "f"), (11, 2, at(9), "user", None, None, "f"),
    ], row)
    got = {r["id"]: (r["kind"], r["prior_tool"], r["context_before"]) for r in o.positive_records(turns).collect()}
    assert got == {5: ("implicit_approval", "Edit", "x" * 200), 8: ("gratitude", "Edit", "x" * 200), 10: ("confirmation", None, None)}


def test_cluster_rows(spark):
    e = [error(3, 5, "Read", "late", session="b"), error(2, 1, None, "first", kind=""), error(4, 1, "Bash", "second", session="b"), error(5, 9, "Bash"), error(6, 9, None, kind=None), error(7, None, "Edit", None, pattern=None, kind=None)]
    got = {r["pattern_id"]: tuple(r)[1:] for r in o.cluster_rows(spark.createDataFrame(e, ERROR)).collect()}
    assert got == {"p-1": ("first", None, "tool_failure", 5, 2, at(1), at(9)), None: (None, "Edit", "error", 1, 1, None, None)}
    assert o.cluster_rows(spark.createDataFrame([], ERROR)).collect() == []


def test_flow_table(spark):
    row = "flow_hash string, sequence string, size int, success int, duration double, session_id long, ts timestamp_ntz"
    flows = [(h, h, 2, s, d, n, at(n)) for h, s, d, n in [("a", 1, 1.0, 1), ("a", 0, 2.0, 2), ("a", 0, None, 2), ("b", 1, 4.0, 1), ("b", 1, 4.0, 2), ("b", 0, 5.0, 3), ("c", 1, 1.0, 1), ("c", 1, 1.0, 2)]]
    got = [(r["rank"], r["flow_hash"], r["total"], r["successes"], r["success_rate"], r["avg_duration"], r["sessions"], r["last_seen"]) for r in o.flow_table(spark.createDataFrame(flows, row)).orderBy("rank").collect()]
    assert got == [(1, "b", 3, 2, 66.7, 4.3, 3, at(3)), (2, "a", 3, 1, 33.3, 1.5, 2, at(2))]
    assert o.flow_table(spark.createDataFrame(flows, row), 2, 1).first()["flow_hash"] == "b"


def test_health_and_modes(spark):
    row = "actual_action string, platform string, behavior_type string, activated boolean, correct_action boolean, correct_outcome boolean, user_satisfied boolean"
    calls = spark.createDataFrame([("a", "x", "skill", True, False, False, True), ("a", "x", "skill", False, False, True, False), ("a", "x", "skill", None, None, None, None), ("a", "y", "skill", True, True, True, None), (None, "y", "hook", True, None, False, True)], row)
    assert {(r[0], r[1]): tuple(r)[2:] for r in o.health_by_platform(calls).collect()} == {("a", "x"): (3, 1, 1, 1, 1, 1, 0.5), ("a", "y"): (1, 0, 0, 1, 0, 0, None), (None, "y"): (1, 1, 0, 0, 0, 0, 1.0)}
    assert {(r["behavior_type"], r["mode"]): r["n"] for r in o.failure_modes(calls).collect()} == {
        ("skill", "incorrect_outcome"): 1, ("skill", "not_activated"): 1, ("skill", "wrong_action"): 2, ("hook", "incorrect_outcome"): 1, ("hook", "not_activated"): 0, ("hook", "wrong_action"): 0,
    }


def test_frictions_equal_a_loop(spark):
    r = random.Random(5)
    e = [("app", c, "k", None if r.random() < 0.05 else at(r.choice([0, 60, 720, 721, 900, 901]) + 60 * r.randrange(3000)), r.choice([None, "pytest || true", "git push --force", "ls", ""])) for c in "abc" for _ in range(120)] + [("app", "few", "k", at(0), "ls")] * 3
    d = spark.createDataFrame(e, "project_tag string, command_category string, error_type string, ts timestamp_ntz, tool_input string")
    got = {x["command_category"]: (x["cycles"], x["active_min"], x["rapid_pct"], x["suppression_pct"], x["resolution"]) for x in o.frictions(d).collect()}
    want = {}
    for c in "abc":
        times = sorted(x[3] for x in e if x[1] == c and x[3])
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        rapid, passed = round(100 * sum(0 < g <= 900 for g in gaps) / 119), round(100 * sum("true" in (x[4] or "") or "--force" in (x[4] or "") for x in e if x[1] == c) / 120)
        want[c] = (120, round(sum(g for g in gaps if 0 < g <= 720) / 60, 1), rapid, passed, "BYPASS" if passed >= 25 else "TRIAL-AND-ERROR" if rapid >= 50 else "FRICTION")
    assert got == want
    calm = spark.createDataFrame([("app", "x", "k", at(s), "ls") for s in (0, 600, 1300, 2300)], d.schema)
    assert tuple(o.frictions(calm).first())[3:] == (4, 21.7, 67, 0, "TRIAL-AND-ERROR")
    with pytest.raises(ValueError):
        o.frictions(d, cap_min=1440)


def test_examples_join_the_old_ones(spark):
    bridge = spark.createDataFrame([("p", i) for i in (1, 2, 2, 3, 4, 99)] + [("q", 1), ("q", 2), (None, 1)], "pattern_id string, error_id long")
    errors = spark.createDataFrame([(1, "bad"), (2, ""), (3, None), (4, "x")], "id long, error_text string")
    old = spark.createDataFrame([("p", 4, 1, "old"), ("p", 50, 0, "gone"), ("r", 1, 0, "r")], "pattern_id string, id long, label int, error_text string")
    got = sorted(tuple(r) for r in o.examples(bridge, errors, old).collect())
    assert got == [("p", 1, 0, "bad", True), ("p", 2, 1, "", True), ("p", 3, 1, "", True), ("p", 4, 1, "old", False), ("p", 50, 0, "gone", False)]
    assert [tuple(r) for r in o.example_counts(o.examples(bridge, errors, old)).collect()] == [("p", 3, 2, 3)]
    assert o.examples(bridge, errors).collect() == [] and len(o.examples(bridge, errors, least=4).collect()) == 4
    # What was built is there the second time: nothing is added.
    assert o.examples(bridge, errors, o.examples(bridge, errors, old)).where("fresh").collect() == []


def test_rule_reports_equal_a_loop(spark):
    r = random.Random(9)
    hours = lambda n: T + timedelta(seconds=r.randrange(n * 3600))
    rules = lambda ts: None if r.random() < 0.2 else [x for x, since in (("a.md#1", 40), ("b/c.md#2", 60), ("a.md#3", 90)) if ts >= T + timedelta(hours=since) and r.random() < 0.7]
    e = [(ts, r.choice(["x", "y", None]), rules(ts)) for ts in (hours(130) for _ in range(400))] + [(None, "x", ["a.md#1"])]
    t0 = {x: min(ts for ts, _, rs in e if ts and rs and x in rs) for x in ("a.md#1", "b/c.md#2", "a.md#3")}
    day = timedelta(days=1)
    e += [(at + d, "edge", None) for at in t0.values() for d in (day, -day, day + timedelta(microseconds=1), -day - timedelta(microseconds=1))]
    got = {(x["rule_id"], x["error_type"]): (x["target_surface"], x["first_seen"], x["before"], x["after"], x["related"]) for x in o.rule_reports(spark.createDataFrame(e, "ts timestamp_ntz, error_type string, rules array<string>"), 1).collect()}
    want = {}
    for rule, at in t0.items():
        near = [(ts, kind or "") for ts, kind, _ in e if ts and at - day <= ts <= at + day]
        related = sorted({x for ts, _, rs in e if ts and rs and rule in rs and ts <= at + day for x in rs} - {rule})
        for kind in {k for _, k in near} | {None}:
            mine = [ts for ts, k in near if kind is None or k == kind]
            want[rule, kind] = (rule.split("#")[0], at, sum(ts < at for ts in mine), sum(ts >= at for ts in mine), related)
    assert got == want and any(x[4] for x in want.values())


def test_rule_advice(spark):
    rows = [(at(-60 * i - 1), "k", None) for i in range(40)] + [(at(60 * i), "k", ["r"]) for i in range(30)] + [(at(1), "few", None)]
    got = {x["error_type"]: (x["delta_pct"], x["tier"], x["advice"]) for x in o.rule_reports(spark.createDataFrame(rows, "ts timestamp_ntz, error_type string, rules array<string>")).collect()}
    assert got == {"k": (-25.0, "medium", "keep"), "few": (None, "low", "more data"), None: (-22.5, "medium", "keep")}
    assert o.rule_reports(spark.createDataFrame([], "ts timestamp_ntz, error_type string, rules array<string>")).collect() == []


def test_pattern_summaries(spark):
    long = "x" * 80
    e = [error(1, 5, "B", long + " one", session="t"), error(2, 4, "A", long.upper() + " two"), error(3, 9, "A", "  "), error(4, 6, None, " other ", kind="undo"), error(5, 7, "C", None, kind="undo"), error(6, None, "", "z" * 300, pattern=None, kind=None)]
    got = {r["pattern_id"]: tuple(r)[1:] for r in o.pattern_summaries(spark.createDataFrame(e, ERROR)).collect()}
    assert got == {"p-1": (5, 2, at(4), at(9), ["A", "B", "C"], [long.upper() + " two", "other"], "claude_md_rule"), None: (1, 1, None, None, [], ["z" * 200], "claude_md_rule")}
    two = o.pattern_summaries(spark.createDataFrame([*e, error(7, 1, kind="undo"), error(8, 2, kind="undo")], ERROR), top=1).where("pattern_id = 'p-1'").first()
    assert two["surface"] == "settings_config" and two["top_tools"] == ["A"] and two["top_messages"] == ["boom"]


def test_topic_patterns(spark):
    texts = spark.createDataFrame([("see PROFILES.YML",), ("profilesxyml",), ("a.b",), ("axb",), ("",), (None,)], "c string")
    found = lambda q: [r["c"] for r in texts.where(texts.c.rlike(o.topic_pattern(q))).collect()]
    assert found("the DBT") == ["see PROFILES.YML"] and found("a.b of") == ["a.b"] and found("a of") == ["see PROFILES.YML", "profilesxyml", "a.b", "axb", ""]


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "in").mkdir()
    for name, body in (("a.jsonl", b"one\n"), ("in/b.jsonl", b"two"), ("c.jsonl", b"x" * 100), ("d.txt", b"y"), ("empty.jsonl", b"")):
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r["sha"] for r in o.file_hashes(spark, str(tmp_path), "*.jsonl", 99).collect()}
    assert got.pop("c.jsonl").startswith("__size_exceeded__") and got == {"a.jsonl": hashlib.sha256(b"one\n").hexdigest(), "b.jsonl": hashlib.sha256(b"two").hexdigest()}


def test_variables_of_error_texts(spark):
    from sessionloom.operators import exports

    texts = [
        (1, "Unexpected keyword argument: 'limit'"), (2, "Input should be a valid number [type=x, input_value='many']"), (3, "(12.5MB) exceeds maximum allowed size of 10MB"), (4, "Failed to fetch page for user: host/page now"), (5, "1 tokens exceeds maximum 2"),
        (6, "ids Input should be a valid list [input_value=kept out]"), (7, None), (8, "for call[find]"),
    ]
    told = lambda *n: {k: v for k, v in exports.variables(spark.createDataFrame([("k", *texts[i - 1]) for i in n], "key string, at long, text string"), "key", "text", "at").first().asDict().items() if v is not None}
    assert told(1) == {"key": "k", "wrong_param": "limit"} and told(2) == {"key": "k", "expected_type": "number", "actual_value": "many"} and told(3) == {"key": "k", "actual_size": "12.5MB", "max_size": "10MB"}
    assert told(4) == {"key": "k", "failed_target": "host/page"} and told(5, 7, 8) == {"key": "k", "actual_tokens": "1", "max_tokens": "2", "function_name": "find"}
    assert told(2, 6) == {"key": "k", "field_name": "ids", "expected_type": "list", "actual_value": "many"}
