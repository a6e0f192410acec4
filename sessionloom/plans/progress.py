"""Queries over snapshots, effects, cohorts, assertions, suggestions and labels."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import mining
from sessionloom.operators import progress as o
from sessionloom.plans.mining import ERRORS
from sessionloom.sources.bind import RULE_FILES, TRACE, rule_files, table, trace

AS_OF = "2024-01-28 00:00:00"
KNOWN = ("bash", "read", "docs")


def _errors(s, d):
    return mining.error_records(trace(s, d)).withColumn("pattern_id", F.col("session_id").cast("long") % 25)


def _applied(s, d):
    e = _errors(s, d).groupBy(F.col("command_category").alias("kind")).agg(F.min("ts").alias("a"), F.min("id").alias("suggestion_id"))
    return e.where("suggestion_id % 3 > 0").select("kind", (F.date_trunc("day", "a") + F.make_dt_interval(F.lit(10))).alias("since"), (F.col("suggestion_id") % 10).alias("suggestion_id"))


def _snaps(s, d):
    return o.snapshots(_errors(s, d), "command_category", _applied(s, d))


def _suggestions(s, d):
    c = table(s, d, "customer")
    return c.select(
        F.col("c_custkey").alias("suggestion_id"), (F.col("c_nationkey").cast("long")).alias("pattern_id"), F.round((F.col("c_acctbal") + 1000) / 11000, 4).alias("confidence"),
        F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 2).cast("int")).alias("arena_passed"), F.when(F.col("c_custkey") % 5 == 0, F.round(F.col("c_acctbal") / 10000, 4)).alias("arena_score"),
        F.when(F.col("c_mktsegment") == "BUILDING", "rejected").when(F.col("c_mktsegment") == "MACHINERY", "approved").otherwise("pending").alias("status"), F.when(F.col("c_custkey") % 9 == 0, "2024").alias("superseded_at"), "c_mktsegment",
    )


def _log(s, d):
    return trace(s, d).select((F.col("session_id") % 40).alias("name"), F.when(F.col("k") % 17 == 0, "close").when(F.col("k") % 5 == 0, "open").alias("op"), "ts").where("op is not null and ts > timestamp'2024-01-09'")


def _windows(s, d):
    return o.windows(o.experiments(_log(s, d)), F.lit(AS_OF).cast("timestamp"))


def _configs(s, d):
    f = rule_files(s, d)
    return f.select(F.regexp_extract("path", r"(\d)\.md$", 1).alias("root"), "path", F.col("text").alias("content"))


def _subjects(s, d):
    e = _errors(s, d).groupBy(F.col("pattern_id").alias("subject")).agg(
        F.count_if(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("a"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("b"), F.count("*").alias("n_lines"),
        F.collect_set(F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), F.col("command_category"))).alias("pre_kinds"), F.collect_set(F.when(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"), F.col("command_category"))).alias("post_kinds"),
    )
    return e.withColumns({"pre_rate": F.round(F.col("a") / F.col("n_lines"), 6), "post_rate": F.round(F.col("b") / F.col("n_lines"), 6), "confidence": F.round(F.col("a") / (F.col("b") + 1), 6)})


def _calls(s, d):
    tr = trace(s, d).where("tool_name is not null")
    return tr.select(
        "id", F.col("tool_name").alias("skill"), F.element_at(F.array(F.lit("claude"), F.lit("goose"), F.lit("codex")), (F.col("id") % 3 + 1).cast("int")).alias("platform"),
        F.when(F.col("id") % 7 == 0, "[UNAVAILABLE]").otherwise("m").alias("message"), F.when(F.col("k") % 3 == 0, (F.col("k") % 2).cast("int")).alias("user_satisfied"), F.when(F.col("k") % 11 == 0, "inline").alias("labelled_by"),
    )


def _signals(s, d):
    return trace(s, d).where("k % 6 = 0").select((F.col("id") - F.col("k") % 4).alias("id"), F.when(F.col("k") % 4 == 0, "++").otherwise("--").alias("signal"), F.struct("ts", "id").alias("at"))


def _flags(s, d):
    return trace(s, d).where("content is not null").select((F.col("session_id") % 30).alias("skill"), F.col("content").alias("note"), F.struct("ts", "id").alias("at"))


KEY = "command_category"
APPLIED = f"ap AS (SELECT {KEY} AS kind, date_trunc('day', min(ts)) + INTERVAL 10 DAY AS since, min(id) % 10 AS suggestion_id FROM e GROUP BY 1 HAVING min(id) % 3 > 0)"
SNAPS = f"""{ERRORS}, {APPLIED}, sn0 AS (SELECT {KEY} AS kind, CAST(date_trunc('day', ts) AS TIMESTAMP) AS created_at, count(*) AS n FROM e GROUP BY 1, 2),
 sn AS (SELECT sn0.kind, created_at, n, n::DOUBLE / sum(n) OVER (PARTITION BY created_at) AS rate, coalesce(created_at >= since, false) AS rule_applied, CASE WHEN created_at >= since THEN suggestion_id END AS suggestion_id FROM sn0 LEFT JOIN ap ON ap.kind = sn0.kind)"""
SUGGESTIONS = """su AS (SELECT c_custkey AS suggestion_id, CAST(c_nationkey AS BIGINT) AS pattern_id, round((c_acctbal + 1000) / 11000, 4) AS confidence, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 2 END AS arena_passed,
 CASE WHEN c_custkey % 5 = 0 THEN round(c_acctbal / 10000, 4) END AS arena_score, CASE c_mktsegment WHEN 'BUILDING' THEN 'rejected' WHEN 'MACHINERY' THEN 'approved' ELSE 'pending' END AS status, CASE WHEN c_custkey % 9 = 0 THEN '2024' END AS superseded_at FROM customer)"""
RUNS = f"""lg AS (SELECT session_id % 40 AS name, CASE WHEN k % 17 = 0 THEN 'close' WHEN k % 5 = 0 THEN 'open' END AS op, ts FROM t WHERE ts > TIMESTAMP '2024-01-09'), lo AS (SELECT name, min(ts) AS start_ts FROM lg WHERE op = 'open' GROUP BY 1),
 ex AS (SELECT lo.name, start_ts, min(ts) FILTER (WHERE op = 'close' AND ts >= start_ts) AS close_ts FROM lo JOIN lg ON lg.name = lo.name GROUP BY 1, 2),
 wi AS (SELECT name, CASE WHEN close_ts IS NULL THEN 'open' ELSE 'closed' END AS status, start_ts AS lo, coalesce(close_ts, TIMESTAMP '{AS_OF}') AS hi, start_ts - INTERVAL 7 DAY AS base_lo, start_ts AS base_hi FROM ex)"""
CALLS = """ca AS (SELECT id, tool_name AS skill, (['claude', 'goose', 'codex'])[id % 3 + 1] AS platform, CASE WHEN id % 7 = 0 THEN '[UNAVAILABLE]' ELSE 'm' END AS message, CASE WHEN k % 3 = 0 THEN k % 2 END AS user_satisfied, CASE WHEN k % 11 = 0 THEN 'inline' END AS labelled_by FROM t WHERE tool_name IS NOT NULL)"""
HALF = "TIMESTAMP '2024-01-15'"
SUBJECTS = f"""sb AS (SELECT CAST(session_id AS BIGINT) % 25 AS subject, count(*) FILTER (WHERE ts < {HALF}) AS a, count(*) FILTER (WHERE ts >= {HALF}) AS b, count(*) AS n, list(DISTINCT {KEY}) FILTER (WHERE ts < {HALF}) AS pk, list(DISTINCT {KEY}) FILTER (WHERE ts >= {HALF}) AS qk FROM e GROUP BY 1),
 sc AS (SELECT *, round(a / n, 6) AS pre, round(b / n, 6) AS post, round(a / (b + 1), 6) AS conf, CAST(len(list_filter(coalesce(qk, []), lambda x: NOT list_contains(coalesce(pk, []), x))) AS DOUBLE) AS fresh FROM sb)"""

QUERIES = {
    "velocity_snapshots": (
        lambda s, d: o.appended((x := _snaps(s, d)).where("created_at < timestamp'2024-01-16'"), x.where("created_at >= timestamp'2024-01-10'"), ["kind", "created_at"]).withColumn("rate", F.round("rate", 6)),
        f"WITH {SNAPS} SELECT kind, created_at, n, round(rate, 6) AS rate, rule_applied, suggestion_id FROM sn",
    ),
    "correction_decay": (
        lambda s, d: o.correction_decay(_errors(s, d), KEY, _applied(s, d).select("kind", "since"), F.lit(AS_OF).cast("timestamp"), 9).select("kind", *[F.round(c, 6).alias(c) for c in ("pre_rate", "rate", "decay")]),
        f"""WITH {ERRORS}, {APPLIED}, x AS (SELECT kind, {KEY} = kind AS same, ts >= since - INTERVAL 9 DAY AND ts <= since AS p, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 9 DAY AND ts <= TIMESTAMP '{AS_OF}' AS q FROM ap, e),
        y AS (SELECT kind, coalesce(count(*) FILTER (WHERE p AND same)::DOUBLE / nullif(count(*) FILTER (WHERE p), 0), 0) AS a, coalesce(count(*) FILTER (WHERE q AND same)::DOUBLE / nullif(count(*) FILTER (WHERE q), 0), 0) AS b FROM x WHERE p OR q GROUP BY 1)
        SELECT kind, round(a, 6) AS pre_rate, round(b, 6) AS rate, round(coalesce((a - b) / nullif(a, 0), 0), 6) AS decay FROM y""",
    ),
    "velocity_trends": (
        lambda s, d: o.trends(_snaps(s, d)).select("kind", "created_at", "place", F.round("rate", 6).alias("rate"), F.round("change", 6).alias("change")),
        f"WITH {SNAPS} SELECT kind, created_at, CAST(row_number() OVER w AS INTEGER) AS place, round(rate, 6) AS rate, round(rate - lag(rate) OVER w, 6) AS change FROM sn WINDOW w AS (PARTITION BY kind ORDER BY created_at)",
    ),
    "skill_effects": (
        lambda s, d: o.skill_effects(_suggestions(s, d).select("suggestion_id", "pattern_id"), _errors(s, d).select("pattern_id", F.col(KEY).alias("kind")), _snaps(s, d)),
        f"""WITH {SNAPS}, {SUGGESTIONS}, m AS (SELECT CAST(session_id AS BIGINT) % 25 AS pattern_id, {KEY} AS kind, count(*) AS n FROM e GROUP BY 1, 2), tp AS (SELECT pattern_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, kind) AS r FROM m) WHERE r = 1),
        q AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY created_at) AS place FROM sn), j AS (SELECT su.suggestion_id, tp.kind, q.created_at, q.rate, place, min(place) FILTER (WHERE q.suggestion_id = su.suggestion_id AND rule_applied) OVER (PARTITION BY su.suggestion_id) AS f0 FROM su LEFT JOIN tp ON tp.pattern_id = su.pattern_id LEFT JOIN q ON q.kind = tp.kind),
        g AS (SELECT suggestion_id, kind, count(place) AS tracked, avg(rate) FILTER (WHERE f0 > 1 AND place < f0) AS a, avg(rate) FILTER (WHERE f0 > 1 AND place >= f0) AS b, arg_min(rate, created_at) AS c, arg_max(rate, created_at) AS z FROM j GROUP BY 1, 2),
        h AS (SELECT *, coalesce(a, c) AS pre, coalesce(b, z) AS post FROM g) SELECT suggestion_id, kind, round(pre, 4) AS pre_rate, round(post, 4) AS post_rate, CASE WHEN pre IS NULL THEN NULL WHEN pre > 0 AND tracked > 1 THEN round((pre - post) / pre * 100, 1) ELSE 0.0 END AS improvement_pct, tracked FROM h""",
    ),
    "declining_rules": (
        lambda s, d: o.declining(_snaps(s, d)).select("kind", *[F.round(c, 6).alias(c) for c in ("first", "latest")]),
        f"WITH {SNAPS}, x AS (SELECT kind, arg_min(rate, created_at) AS a, arg_max(rate, created_at) AS b FROM sn WHERE rule_applied GROUP BY 1) SELECT kind, round(a, 6) AS first, round(b, 6) AS latest FROM x WHERE b > a",
    ),
    "experiment_store": (
        lambda s, d: o.experiments(_log(s, d)),
        f"WITH {TRACE}, {RUNS} SELECT name, start_ts, close_ts, CASE WHEN close_ts IS NULL THEN 'open' ELSE 'closed' END AS status FROM ex",
    ),
    "cohort_windows": (
        lambda s, d: _windows(s, d),
        f"WITH {TRACE}, {RUNS} SELECT * FROM wi",
    ),
    "cohort_reports": (
        lambda s, d: o.cohort_report(_windows(s, d), _errors(s, d), KEY, _suggestions(s, d)),
        f"""WITH {ERRORS}, {RUNS}, {SUGGESTIONS}, me AS (SELECT name, {KEY} AS kind, CAST(e.session_id AS BIGINT) % 25 AS pattern_id, e.ts >= lo AND e.ts <= hi AS i, e.ts >= base_lo AND e.ts < base_hi AS b FROM wi, e),
        kk AS (SELECT name, kind, count(*) FILTER (WHERE i) AS i, count(*) FILTER (WHERE b) AS b FROM me GROUP BY 1, 2), cc AS (SELECT name, CAST(sum(i) AS BIGINT) AS errors, CAST(sum(b) AS BIGINT) AS base_errors, count(*) FILTER (WHERE i > 0 AND b = 0) AS new_kinds FROM kk GROUP BY 1),
        gg AS (SELECT name, count(DISTINCT suggestion_id) AS suggestions FROM (SELECT DISTINCT name, pattern_id FROM me WHERE i) x JOIN su ON su.pattern_id = x.pattern_id GROUP BY 1),
        rr AS (SELECT wi.name, errors, base_errors, new_kinds, coalesce(suggestions, 0) AS suggestions, coalesce(errors::DOUBLE / nullif(floor(date_diff('microsecond', lo, hi) / 1e6) / 3600, 0), 0) AS a, coalesce(base_errors::DOUBLE / nullif(floor(date_diff('microsecond', base_lo, base_hi) / 1e6) / 3600, 0), 0) AS z FROM wi JOIN cc ON cc.name = wi.name LEFT JOIN gg ON gg.name = wi.name)
        SELECT name, errors, base_errors, round(a, 4) AS per_hour, round(z, 4) AS base_per_hour, round((a - z) / nullif(z, 0) * 100, 1) AS delta_pct, new_kinds, suggestions FROM rr""",
    ),
    "config_hashes": (
        lambda s, d: o.config_hashes(_configs(s, d)),
        rf"WITH {RULE_FILES} SELECT regexp_extract(path, '(\d)\.md$', 1) AS root, count(*) AS n_files, sha256(string_agg(path || '=' || sha256(text), chr(10) ORDER BY path || '=' || sha256(text))) AS config_hash FROM f GROUP BY 1",
    ),
    "resolutions": (
        lambda s, d: o.resolutions(_errors(s, d)),
        f"""WITH {ERRORS}, x AS (SELECT project_tag, {KEY}, error_type, count(*) AS n, count(DISTINCT session_id) AS sessions, bool_or(coalesce(regexp_matches(CASE WHEN json_valid(tool_input) THEN json_extract_string(tool_input, '$.command') END, '(?i){t.BYPASSES}'), false)) AS suppression, arg_max(id, {{'t': ts, 'i': id}}) AS anchor FROM e GROUP BY 1, 2, 3)
        SELECT *, CASE WHEN sessions >= 3 THEN 'RECURRING' WHEN suppression THEN 'BYPASS' ELSE 'UNDECIDED' END AS resolution FROM x WHERE n >= 4""",
    ),
    "assertion_results": (
        lambda s, d: o.run_assertions(_subjects(s, d), ["error_rate_decreased", "no_new_regressions", "confidence_above_threshold", "budget_within_limits", "no_such_assertion"]),
        f"""WITH {ERRORS}, {SUBJECTS} SELECT subject, 'error_rate_decreased' AS name, post <= pre AS passed, post AS actual, pre AS threshold FROM sc UNION ALL SELECT subject, 'no_new_regressions', fresh = 0, fresh, 0.0 FROM sc
        UNION ALL SELECT subject, 'confidence_above_threshold', conf >= 0.7, conf, 0.7 FROM sc UNION ALL SELECT subject, 'budget_within_limits', n <= 100, n, 100.0 FROM sc UNION ALL SELECT subject, 'no_such_assertion', false, 0.0, 0.0 FROM sc""",
    ),
    "auto_suggestions": (
        lambda s, d: o.auto_suggestions(_errors(s, d).groupBy("pattern_id").agg(F.count("*").alias("n")).withColumn("grade", F.when(F.col("n") >= 20, "strong").otherwise("emerging")), _suggestions(s, d).where("confidence > 0.97")).select("pattern_id", "n"),
        f"WITH {ERRORS}, {SUGGESTIONS} SELECT CAST(session_id AS BIGINT) % 25 AS pattern_id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 20 AND CAST(session_id AS BIGINT) % 25 NOT IN (SELECT pattern_id FROM su WHERE confidence > 0.97)",
    ),
    "change_targets": (
        lambda s, d: (x := trace(s, d).groupBy("tool_name").agg(F.count("*").alias("n")).withColumn("change", o.change_type(F.col("tool_name"), KNOWN))).select("tool_name", "n", "change", o.target_file(F.col("tool_name"), F.col("change"), KNOWN).alias("target"), o.optimiser(F.lit("auto"), F.col("n"), 600).alias("optimiser")),
        f"""WITH {TRACE}, x AS (SELECT tool_name, count(*) AS n, lower(coalesce(tool_name, '')) AS l FROM t GROUP BY 1), y AS (SELECT *, CASE WHEN {' OR '.join(f"contains(l, '{k}')" for k in KNOWN)} THEN 'tool_rule' WHEN contains(l, 'hook') THEN 'hook_config' WHEN contains(l, 'skill') THEN 'skill_update' WHEN l NOT IN ('', 'unknown', 'unknown tool') THEN 'tool_rule' ELSE 'claude_md_rule' END AS change FROM x)
        SELECT tool_name, n, change, CASE change WHEN 'tool_rule' THEN '.claude/rules/tools/' || CASE {' '.join(f"WHEN contains(l, '{k}') THEN '{k}'" for k in KNOWN)} ELSE string_split(replace(l, 'mcp__', ''), '__')[1] END || '.md' WHEN 'hook_config' THEN '.claude/hooks/' WHEN 'skill_update' THEN '.claude/skills/' ELSE 'CLAUDE.md' END AS target, CASE WHEN n >= 600 THEN 'miprov2' ELSE 'bootstrap' END AS optimiser FROM y""",
    ),
    "suggestion_modes": (
        lambda s, d: _suggestions(s, d).select("suggestion_id", o.mode(F.col("confidence"), F.when(F.col("suggestion_id") % 2 == 0, "claude_md_rule").otherwise("hook_config")).alias("mode")),
        f"WITH {SUGGESTIONS} SELECT suggestion_id, CASE WHEN confidence >= 0.8 AND suggestion_id % 2 = 0 THEN 'auto' ELSE 'hitl' END AS mode FROM su",
    ),
    "suggestion_tally": (
        lambda s, d: o.tally(_suggestions(s, d), 0.8),
        f"""WITH {SUGGESTIONS}, x AS (SELECT *, CAST(coalesce(arena_score, confidence, 0) AS DOUBLE) AS s FROM su WHERE status <> 'rejected' AND coalesce(superseded_at, '') = ''), y AS (SELECT count(*) AS candidates, count(*) FILTER (WHERE arena_passed = 1 AND s >= 0.8) AS promoted,
        count(*) FILTER (WHERE arena_passed IS NULL OR arena_passed = 1 AND s < 0.8) AS pending_approval, count(*) FILTER (WHERE arena_passed = 0) AS rejected_arena, coalesce(round(avg(s), 4), 0) AS average FROM x)
        SELECT *, CASE WHEN promoted > 0 THEN 'promoted' WHEN pending_approval > 0 THEN 'pending_approval' WHEN rejected_arena > 0 THEN 'rejected_arena' ELSE 'no_candidates' END AS outcome FROM y""",
    ),
    "review_queue": (
        lambda s, d: o.review_queue(_suggestions(s, d), 20).select("suggestion_id", "pattern_id", "confidence"),
        f"WITH {SUGGESTIONS} SELECT suggestion_id, pattern_id, confidence FROM su WHERE status = 'pending' ORDER BY confidence DESC, suggestion_id LIMIT 20",
    ),
    "calls_by_platform": (
        lambda s, d: _calls(s, d).groupBy("platform").agg(F.count("*").alias("n")),
        f"WITH {TRACE}, {CALLS} SELECT platform, count(*) AS n FROM ca GROUP BY 1",
    ),
    "training_calls": (
        lambda s, d: o.training_rows(_calls(s, d), 100).select("id", "skill", "platform"),
        f"WITH {TRACE}, {CALLS}, x AS (SELECT *, count(*) OVER (PARTITION BY skill, platform) AS n FROM ca WHERE (user_satisfied IS NOT NULL OR labelled_by IS NOT NULL) AND message <> '[UNAVAILABLE]') SELECT id, skill, platform FROM x WHERE n >= 100",
    ),
    "label_writes": (
        lambda s, d: o.labelled(_calls(s, d), _signals(s, d)).select("id", "user_satisfied", "labelled_by"),
        f"WITH {TRACE}, {CALLS}, sg AS (SELECT id - k % 4 AS id, arg_max(CAST(k % 4 = 0 AS INTEGER), {{'t': ts, 'i': id}}) AS v FROM t WHERE k % 6 = 0 GROUP BY 1) SELECT ca.id, coalesce(v, user_satisfied) AS user_satisfied, CASE WHEN v IS NOT NULL THEN 'batch_review' ELSE labelled_by END AS labelled_by FROM ca LEFT JOIN sg ON sg.id = ca.id",
    ),
    "flagged_skills": (
        lambda s, d: o.flagged(_flags(s, d)),
        f"WITH {TRACE} SELECT session_id % 30 AS skill, count(*) AS n, arg_max(trim(content), {{'t': ts, 'i': id}}) AS note FROM t WHERE trim(content) <> '' GROUP BY 1",
    ),
    "status_counters": (
        lambda s, d: o.counters({"errors": _errors(s, d), "calls": trace(s, d).where("tool_name is not null"), "suggestions": _suggestions(s, d), "documents": table(s, d, "documents")}, {"errors": "time_bucket", "calls": "id"}),
        f"WITH {ERRORS} SELECT 'errors' AS name, count(*) AS n, max(time_bucket) AS latest FROM e UNION ALL SELECT 'calls', count(*), CAST(max(id) AS VARCHAR) FROM t WHERE tool_name IS NOT NULL UNION ALL SELECT 'suggestions', count(*), NULL FROM customer UNION ALL SELECT 'documents', count(*), NULL FROM documents",
    ),
}
