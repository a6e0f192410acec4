"""Queries over curated records, promotions, clusters, flows, health, frictions, built datasets and tables with keys."""

import uuid

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import datasets, exports, mining
from sessionloom.operators import selecting as o
from sessionloom.operators.store import shared_dir
from sessionloom.plans.exports import FLOWS
from sessionloom.plans.mining import ERRORS
from sessionloom.plans.signals import PN
from sessionloom.sources.bind import STREAM, TALK, TRACE, table, talk, tool_stream, trace
from sessionloom.sources.keyed import KeyedTable

W = "(PARTITION BY session_id ORDER BY ts, id"
SINCE, HOURS_6 = "2024-01-08 00:00:00", 21600

# Patterns and kinds of errors, and the sentiment of positive records, by the rows' own numbers.
PATTERN = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN concat('Cascade-', command_category) ELSE concat(command_category, '-', CAST(id % 3 AS {text})) END"
KIND = "CASE id % 5 WHEN 0 THEN 'user_correction' WHEN 1 THEN 'undo' ELSE 'tool_failure' END"
MOOD = "CASE WHEN id % 5 > 0 THEN (id % 9) / CAST(8 AS DOUBLE) END"
CALLS = {
    "actual_action": "tool", "platform": "concat('p', CAST(session_id % 3 AS {text}))", "behavior_type": "CASE WHEN k % 2 = 0 THEN 'skill' ELSE 'tool' END", "activated": "k % 5 > 0", "correct_action": "k % 3 <> 0",
    "correct_outcome": "id % 4 <> 1", "user_satisfied": "CASE WHEN k % 4 <> 0 THEN k % 8 > 2 END",
}


def _columns(columns, text):
    return [f"{e.format(text=text)} AS {n}" for n, e in columns.items()]


def _errors(s, d):
    return mining.error_records(trace(s, d)).withColumns({"pattern_id": F.expr(PATTERN.format(text="STRING")), "error_type": F.expr(KIND)})


def _positives(s, d):
    return o.positive_records(trace(s, d)).withColumn("sentiment", F.expr(MOOD))


def _truths(s, d):
    tail = F.substring_index("pattern_id", "-", -1)
    return _errors(s, d).select("pattern_id", F.when(tail == "1", "pending").otherwise("approved").alias("label"), F.lit("positive_record").alias("source")).distinct()


def _calls(s, d):
    return tool_stream(s, d).selectExpr(*_columns(CALLS, "STRING"))


def _bridge(s, d):
    return trace(s, d).where("tool_name is not null").select(F.concat("tool_name", F.lit("-"), (F.col("k") % 11).cast("string")).alias("pattern_id"), F.col("id").alias("error_id"))


def _examples(s, d):
    old = _bridge(s, d).where("error_id % 9 = 0").select("pattern_id", F.col("error_id").alias("id"), F.lit(1).alias("label"), F.lit("kept").alias("error_text"))
    return o.examples(_bridge(s, d).where("error_id % 4 > 0"), trace(s, d).withColumnRenamed("error", "error_text"), old)


# The ids of the rules in force at an error: a tool's and a common one.
RULES = ("concat('tools/', command_category, '.md#', CAST(k % 3 AS {text}))", "concat('core.md#', CAST(CAST(session_id AS BIGINT) % 4 AS {text}))")


def _ruled(s, d):
    both = ", ".join(RULES).format(text="STRING")
    return _errors(s, d).withColumn("rules", F.expr(f"CASE WHEN id % 6 > 0 THEN array({both}) END"))


def _keyed(s, *keys):
    return KeyedTable(s, f"{shared_dir(s)}/keyed-{uuid.uuid4().hex}", keys)


def _synced(s, d):
    """Calls of two platforms put into one table: the early ones, then all, then all again."""
    calls = tool_stream(s, d).select(F.concat(F.lit("p"), (F.col("session_id") % 3).cast("string")).alias("platform"), "session_id", F.date_trunc("day", "ts").alias("day"), "tool")
    t = _keyed(s, "platform", "session_id", "day", "tool")
    t.insert_new(calls.where(F.col("day") < F.to_timestamp(F.lit(SINCE))))
    t.insert_new(calls)
    t.insert_new(calls)
    return t.read()


def _labelled(s, d):
    """Labels written, then some written anew and one for every third document that had none."""
    labels = table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    t = _keyed(s, "doc_id")
    t.insert_new(labels.where("doc_id % 3 > 0"))
    t.merge(labels.where("doc_id % 4 = 0").withColumn("label", F.concat("label", F.lit("+"))))
    t.insert_new(labels)
    return t.read()


RECORDS = f"""{ERRORS}, r AS (SELECT e.* EXCLUDE (error_type), t.source_file, {PATTERN.format(text='VARCHAR').replace('id %', 'e.id %')} AS pattern_id, {KIND.replace('id %', 'e.id %')} AS error_type FROM e JOIN t ON t.id = e.id)"""
POSITIVES = f"""p0 AS (SELECT *, {PN}, last_value(tool_name IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_tool,
 last_value(CASE WHEN role = 'assistant' THEN substr(content, 1, 200) END IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_before FROM t),
 p1 AS (SELECT *, CASE WHEN {t.any_of_sql('content', t.CONFIRMATION)} THEN 'confirmation' WHEN {t.any_of_sql('content', t.GRATITUDE)} THEN 'gratitude'
  WHEN prior_tool IS NOT NULL AND len(regexp_extract_all(content, '\\S+')) < 20 AND p > 0 AND n = 0 THEN 'implicit_approval' END AS kind, {MOOD} AS sentiment FROM p0 WHERE role = 'user' AND tool_name IS NULL AND trim(content) <> ''),
 p2 AS (SELECT * FROM p1 WHERE kind IS NOT NULL)"""
CALL_ROWS = f"{STREAM}, c AS (SELECT {', '.join(_columns(CALLS, 'VARCHAR'))} FROM s)"
BUILT = f"""{TRACE}, b AS (SELECT concat(tool_name, '-', CAST(k % 11 AS VARCHAR)) AS pattern_id, id, error FROM t WHERE tool_name IS NOT NULL), x AS (
 SELECT pattern_id, id, 1 AS label, 'kept' AS error_text, false AS fresh FROM b WHERE id % 9 = 0 UNION ALL SELECT pattern_id, id, CAST(coalesce(error, '') = '' AS INTEGER), coalesce(error, ''), true FROM b WHERE id % 4 > 0 AND id % 9 > 0),
 y AS (SELECT * FROM x WHERE pattern_id IN (SELECT pattern_id FROM x GROUP BY 1 HAVING count(*) >= 5))"""

RULED = f"""{RECORDS}, w AS (SELECT r.id, r.ts, error_type, CASE WHEN r.id % 6 > 0 THEN [{', '.join(RULES).format(text='VARCHAR').replace('session_id', 'r.session_id')}] END AS rules FROM r JOIN t ON t.id = r.id),
 u AS (SELECT id, ts, rules, unnest(rules) AS rule_id FROM w), f AS (SELECT rule_id, min(ts) AS t0 FROM u GROUP BY 1),
 sb AS (SELECT rule_id, list_sort(list(DISTINCT other)) AS related FROM (SELECT u.rule_id, t0, ts, unnest(rules) AS other FROM u JOIN f ON f.rule_id = u.rule_id) WHERE other <> rule_id AND ts <= t0 + INTERVAL 7 DAY GROUP BY 1),
 c AS (SELECT rule_id, t0, error_type, count(*) FILTER (WHERE ts < t0) AS before, count(*) FILTER (WHERE ts >= t0) AS after FROM w JOIN f ON ts >= t0 - INTERVAL 7 DAY AND ts <= t0 + INTERVAL 7 DAY GROUP BY GROUPING SETS ((rule_id, t0, error_type), (rule_id, t0))),
 q AS (SELECT c.rule_id, string_split(c.rule_id, '#')[1] AS target_surface, t0 AS first_seen, error_type, before, after, round(100.0::DOUBLE * (after - before) / nullif(before, 0), 4) AS delta_pct, coalesce(related, []) AS related FROM c LEFT JOIN sb ON sb.rule_id = c.rule_id)"""
TOPIC = o.topic_pattern("the path of cube")

QUERIES = {
    "trace_positives": (
        lambda s, d: _positives(s, d).select("id", "kind", "context_before", "prior_tool"),
        f"WITH {TRACE}, {POSITIVES} SELECT id, kind, context_before, prior_tool FROM p2",
    ),
    "curated_records": (
        lambda s, d: o.curated(_errors(s, d), o.Filters(since=SINCE, classified=True, error_types=("tool_failure", "user_correction"), recovered_within=HOURS_6), _positives(s, d)).select("id", "error_type", "pattern_id"),
        f"""WITH {RECORDS}, {POSITIVES} SELECT id, error_type, pattern_id FROM r WHERE ts >= TIMESTAMP '{SINCE}' AND coalesce(pattern_id, '') <> '' AND error_type IN ('tool_failure', 'user_correction') AND error_type <> 'user_correction' AND pattern_id NOT ILIKE '%cascade%'
        AND EXISTS (SELECT 1 FROM p2 WHERE p2.source_file = r.source_file AND p2.ts > r.ts AND date_diff('microsecond', r.ts, p2.ts) < {HOURS_6}000000)""",
    ),
    "curated_shouts": (
        lambda s, d: o.curated(_errors(s, d), o.Filters(emphasis=True, pattern_prefix="BASH", exclude_corrections=False, exclude_cascade=False)).select("id", "error_type", "pattern_id"),
        f"WITH {RECORDS} SELECT id, error_type, pattern_id FROM r WHERE (contains(user_message, '!!') OR contains(user_message, '??')) AND pattern_id ILIKE 'bash%'",
    ),
    "promotable_pairs": (
        lambda s, d: o.promotions(_positives(s, d), _errors(s, d), _truths(s, d), 0.3, SINCE, HOURS_6),
        f"""WITH {RECORDS}, {POSITIVES} SELECT p2.id AS positive_id, r.id AS error_id, pattern_id, kind FROM p2 JOIN r ON r.source_file = p2.source_file AND r.ts < p2.ts AND date_diff('microsecond', r.ts, p2.ts) < {HOURS_6}000000
        WHERE p2.ts >= TIMESTAMP '{SINCE}' AND kind IN {o.PROMOTING} AND coalesce(sentiment, 1.0) >= 0.3 AND (pattern_id IS NULL OR string_split(pattern_id, '-')[-1] <> '1')""",
    ),
    "cluster_rows": (
        lambda s, d: o.cluster_rows(_errors(s, d)),
        f"""WITH {RECORDS}, tn AS (SELECT pattern_id, tool_name, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, min(row(ts, id))) AS i FROM r GROUP BY 1, 2), kn AS (SELECT pattern_id, error_type, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, min(row(ts, id))) AS i FROM r GROUP BY 1, 2),
        g AS (SELECT pattern_id, first(error_text ORDER BY ts, id) AS description, count(*) AS error_count, count(DISTINCT session_id) AS session_count, min(ts) AS first_seen, max(ts) AS last_seen FROM r GROUP BY 1)
        SELECT g.*, tool_name, error_type FROM g JOIN tn ON tn.pattern_id IS NOT DISTINCT FROM g.pattern_id AND tn.i = 1 JOIN kn ON kn.pattern_id IS NOT DISTINCT FROM g.pattern_id AND kn.i = 1""",
    ),
    "flow_table": (
        lambda s, d: o.flow_table(exports.flow_events(exports.tool_stream(trace(s, d)))),
        f"""WITH {FLOWS}, a AS (SELECT flow_hash, min(sequence) AS sequence, min(size) AS size, count(*) AS total, CAST(sum(success) AS BIGINT) AS successes, round(100.0::DOUBLE * sum(success) / count(*), 1) AS success_rate, round(avg(duration), 1) AS avg_duration, count(DISTINCT session_id) AS sessions, max(ts) AS last_seen FROM e GROUP BY 1 HAVING count(*) >= 3)
        SELECT * FROM (SELECT row_number() OVER (ORDER BY successes DESC, total DESC, flow_hash) AS rank, * FROM a) WHERE rank <= 20""",
    ),
    "health_by_platform": (
        lambda s, d: o.health_by_platform(_calls(s, d)),
        f"""WITH {CALL_ROWS} SELECT actual_action, platform, count(*) AS total, count(*) FILTER (WHERE user_satisfied) AS satisfied, count(*) FILTER (WHERE NOT user_satisfied) AS unsatisfied, count(*) FILTER (WHERE user_satisfied IS NULL) AS unlabelled,
        count(*) FILTER (WHERE activated AND NOT correct_action) AS false_triggers, count(*) FILTER (WHERE NOT activated) AS missed_triggers, round(avg(CAST(user_satisfied AS INTEGER)), 6) AS rate FROM c GROUP BY 1, 2""",
    ),
    "failure_modes": (
        lambda s, d: o.failure_modes(_calls(s, d)),
        f"WITH {CALL_ROWS} " + " UNION ALL ".join(f"SELECT behavior_type, '{m}' AS mode, count(*) FILTER (WHERE {x}) AS n FROM c GROUP BY 1" for m, x in o.MODES.items()),
    ),
    "frictions": (
        lambda s, d: o.frictions(_errors(s, d)),
        f"""WITH {RECORDS}, x AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY project_tag, command_category, error_type ORDER BY ts), ts) AS gap FROM r),
        g AS (SELECT project_tag, command_category, error_type, count(*) AS cycles, round(coalesce(sum(gap) FILTER (WHERE gap > 0 AND gap <= 720000000), 0) / 60000000.0::DOUBLE, 1) AS active_min, CAST(round_even(100 * (count(*) FILTER (WHERE gap > 0 AND gap <= 900000000)) / greatest(count(*) - 1, 1), 0) AS BIGINT) AS rapid_pct,
        CAST(round_even(100 * (count(*) FILTER (WHERE coalesce(regexp_matches(tool_input, '(?i){t.BYPASSES}'), false))) / count(*), 0) AS BIGINT) AS suppression_pct FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 4)
        SELECT *, CASE WHEN suppression_pct >= 25 THEN 'BYPASS' WHEN rapid_pct >= 50 THEN 'TRIAL-AND-ERROR' ELSE 'FRICTION' END AS resolution FROM g""",
    ),
    "dataset_examples": (
        lambda s, d: _examples(s, d),
        f"WITH {BUILT} SELECT * FROM y",
    ),
    "dataset_example_counts": (
        lambda s, d: o.example_counts(_examples(s, d)),
        f"WITH {BUILT} SELECT pattern_id, count(*) FILTER (WHERE label = 1) AS positive_count, count(*) FILTER (WHERE label = 0) AS negative_count, count(*) FILTER (WHERE fresh) AS fresh FROM y GROUP BY 1",
    ),
    "rule_reports": (
        lambda s, d: o.rule_reports(_ruled(s, d)).withColumn("related", F.array_join("related", ",")),
        f"""WITH {RULED} SELECT * REPLACE (array_to_string(related, ',') AS related), CASE WHEN after >= 100 THEN 'high' WHEN after >= 25 THEN 'medium' ELSE 'low' END AS tier,
        CASE WHEN after < 25 OR before = 0 THEN 'more data' WHEN 100.0 * (after - before) / before <= -20 THEN 'keep' WHEN 100.0 * (after - before) / before >= 10 THEN 'review' ELSE 'watch' END AS advice FROM q""",
    ),
    "pattern_summaries": (
        lambda s, d: o.pattern_summaries(_errors(s, d)).withColumns({c: F.array_join(c, "|") for c in ("top_tools", "top_messages")}),
        f"""WITH {RECORDS}, g AS (SELECT pattern_id, count(*) AS error_count, count(DISTINCT session_id) AS session_count, min(ts) AS earliest, max(ts) AS latest FROM r GROUP BY 1),
        tn AS (SELECT pattern_id, tool_name, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, tool_name) AS i FROM r WHERE tool_name <> '' GROUP BY 1, 2), kn AS (SELECT pattern_id, error_type, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, error_type) AS i FROM r WHERE error_type <> '' GROUP BY 1, 2),
        mn AS (SELECT pattern_id, first(trim(error_text)[:200] ORDER BY ts, id) AS text, row_number() OVER (PARTITION BY pattern_id ORDER BY min(row(ts, id))) AS i FROM r WHERE trim(error_text) <> '' GROUP BY pattern_id, lower(trim(error_text)[:80])),
        tl AS (SELECT pattern_id, string_agg(tool_name, '|' ORDER BY i) AS top_tools FROM tn WHERE i <= 5 GROUP BY 1), ml AS (SELECT pattern_id, string_agg(text, '|' ORDER BY i) AS top_messages FROM mn WHERE i <= 5 GROUP BY 1)
        SELECT g.*, coalesce(top_tools, '') AS top_tools, coalesce(top_messages, '') AS top_messages, CASE error_type WHEN 'undo' THEN 'settings_config' WHEN 'repeated_attempt' THEN 'hook_config' ELSE 'claude_md_rule' END AS surface
        FROM g LEFT JOIN tl ON tl.pattern_id IS NOT DISTINCT FROM g.pattern_id LEFT JOIN ml ON ml.pattern_id IS NOT DISTINCT FROM g.pattern_id LEFT JOIN kn ON kn.pattern_id IS NOT DISTINCT FROM g.pattern_id AND kn.i = 1""",
    ),
    "topic_messages": (
        lambda s, d: datasets.topic_with_neighbours(talk(s, d), TOPIC).select("session_id", "idx", "step"),
        f"""WITH {TALK}, h AS (SELECT session_id, idx, max(coalesce(regexp_matches(content, '{TOPIC}'), false)) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m)
        SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS step FROM h WHERE near""",
    ),
    "telemetry_store": (
        _synced,
        f"WITH {STREAM} SELECT DISTINCT concat('p', CAST(session_id % 3 AS VARCHAR)) AS platform, session_id, date_trunc('day', ts) AS day, tool FROM s",
    ),
    "label_store": (
        _labelled,
        "SELECT DISTINCT doc_id, CAST(quality AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '+' ELSE '' END AS label FROM labels",
    ),
}
