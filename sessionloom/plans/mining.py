"""Queries over traces: error records, marks, approvals, session ends and facets."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import mining as o
from sessionloom.operators import signals as g
from sessionloom.sources.bind import TRACE, table, trace

W = "(PARTITION BY session_id ORDER BY ts, id"


def _holds(text, patterns):
    return f"coalesce(regexp_matches({text}, '(?i){'|'.join(f'(?:{p})' for p in patterns)}'), false)"


NOISE = f"({_holds('error', t.GUARDS)} OR length(error) < 4096 AND {_holds('error', t.HEADERS)})"
CATEGORY = rf"""CASE WHEN coalesce(tool_name, '') <> 'Bash' OR coalesce(tool_input, '') = '' THEN lower(coalesce(nullif(tool_name, ''), 'unknown'))
 WHEN NOT json_valid(tool_input) THEN 'bash-unparsed' WHEN cmd = '' THEN 'bash-empty' WHEN contains(lower(cmd), 'docker exec') AND contains(lower(cmd), 'psql') THEN 'docker-exec-psql'
 WHEN w IS NULL THEN 'bash-other' WHEN coalesce(regexp_matches(w[2], '{o.SUBCOMMAND}'), false) THEN regexp_extract(w[1], '[^/]*$') || '-' || w[2] ELSE regexp_extract(w[1], '[^/]*$') END"""
COMMAND = "CASE WHEN json_valid(tool_input) THEN trim(coalesce(json_extract_string(tool_input, '$.command'), '')) ELSE '' END"
ERRORS = rf"""{TRACE}, e0 AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_message,
 lag(content) OVER {W}) AS context_before, lead(content) OVER {W}) AS context_after, {COMMAND} AS cmd FROM t),
 e1 AS (SELECT *, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(cmd, '&&|\|\||;|\n'), lambda s: trim(s)), lambda s: s <> '' AND NOT regexp_matches(s, '{o.SCAFFOLD}')),
   lambda s: list_filter(regexp_split_to_array(s, '\s+'), lambda x: NOT regexp_matches(x, '{o.ASSIGNMENT}'))), lambda x: len(x) > 0)[1] AS w FROM e0 WHERE coalesce(error, '') <> '' AND NOT {NOISE}),
 e2 AS (SELECT *, regexp_extract(source_file, '/\.claude/projects/([^/]+)/', 1) AS pn FROM e1),
 e AS (SELECT id, CAST(session_id AS VARCHAR) AS session_id, ts, tool_name, tool_input, output AS tool_output, error AS error_text, 'tool_failure' AS error_type, user_message, context_before, context_after,
  CASE WHEN pn = '' THEN 'unknown' WHEN starts_with(pn, '{o.PREFIX}') AND pn <> '{o.PREFIX}' THEN substr(pn, {len(o.PREFIX) + 1}) ELSE pn END AS project_tag, {CATEGORY} AS command_category, strftime(ts, '%Y-%m-%d') AS time_bucket FROM e2)"""
FIELDS = ["id", "session_id", "error_type", "error_text", "user_message", "context_before", "context_after", "project_tag", "command_category", "time_bucket"]
GOOD = f"(coalesce(regexp_matches(content, '(?i){t.PRAISE}'), false) OR {t.any_of_sql('content', t.CONFIRMATION)} OR {t.any_of_sql('content', t.GRATITUDE)})"


def _stream(s, d):
    return trace(s, d).where("tool_name is not null").select("session_id", F.col("tool_name").alias("tool"), (F.coalesce("error", F.lit("")) != "").alias("is_error"))


def _said(s, d):
    before = F.expr(f"last_value(CASE WHEN role = 'user' THEN content END) IGNORE NULLS OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return trace(s, d).withColumn("message", before).where("tool_name is not null")


def _facets(s, d):
    tr = trace(s, d)
    area = o.error_area(o.error_records(tr), "command_category").select(F.col("session_id").cast("long").alias("session_id"), "area")
    mood = g.complexity(tr.where("role = 'user'").select("session_id", F.coalesce("content", F.lit("")).alias("content"))).select("session_id", "band", "mood")
    cache = tr.where("session_id % 2 = 0").select("session_id").distinct().select("session_id", F.lit("stale").alias("key"))
    return o.facets(tr, g.tool_mastery(_stream(s, d)).select("session_id", "mastery"), area, mood, cache).select("session_id", "key", "mastery", "area", "band", "mood")


QUERIES = {
    "mined_errors": (
        lambda s, d: o.error_records(trace(s, d)).select(*FIELDS),
        f"WITH {ERRORS} SELECT {', '.join(FIELDS)} FROM e",
    ),
    "stamped_errors": (
        lambda s, d: o.stamped(o.error_records(trace(s, d)).select("id", "command_category"), table(s, d, "nation").select(F.col("n_name").alias("rule_id"))),
        f"WITH {ERRORS} SELECT id, command_category, (SELECT string_agg(DISTINCT n_name, ',' ORDER BY n_name) FROM nation) AS rule_snapshot FROM e",
    ),
    "user_marks": (
        lambda s, d: o.user_marks(trace(s, d)).select("id", "correction_prefix", "emphasis"),
        f"WITH {TRACE} SELECT id, {' OR '.join(f'''starts_with(lower(trim(content)), '{p}')''' for p in t.PREFIXES)} AS correction_prefix, contains(content, '!!') OR contains(content, '??') AS emphasis FROM t WHERE role = 'user' AND content IS NOT NULL",
    ),
    "call_marks": (
        lambda s, d: o.call_marks(trace(s, d)).select("id", "activated", "correct_action", "correct_outcome", "suppression"),
        f"""WITH {TRACE} SELECT id, CAST(output IS NOT NULL AS INTEGER) AS activated, CAST(coalesce(error, '') = '' AS INTEGER) AS correct_action, CAST(coalesce(error, '') = '' AND coalesce(output, '') <> '' AS INTEGER) AS correct_outcome,
        regexp_matches({COMMAND}, '(?i){t.BYPASSES}') AS suppression FROM t WHERE tool_name IS NOT NULL""",
    ),
    "approval_by_response": (
        lambda s, d: o.approvals_by_response(trace(s, d)),
        f"""WITH {TRACE}, a AS (SELECT *, first_value(CASE WHEN role = 'user' THEN coalesce(content, '') END IGNORE NULLS) OVER {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS answer FROM t),
        b AS (SELECT *, {t.any_of_sql('answer', t.REJECTION)} OR coalesce(regexp_matches(answer, '{o.NO}'), false) AS no FROM a WHERE tool_name IS NOT NULL)
        SELECT tool_name, count(*) FILTER (WHERE NOT no) AS approved, count(*) FILTER (WHERE no) AS rejected, round(count(*) FILTER (WHERE NOT no)::DOUBLE / count(*), 6) AS rate FROM b GROUP BY 1""",
    ),
    "session_successes": (
        lambda s, d: o.session_successes(trace(s, d)),
        f"""WITH {TRACE}, r AS (SELECT *, row_number() OVER {W}) AS n, role = 'user' AND {GOOD} AS good FROM t), l AS (SELECT session_id, max(n) AS last FROM r WHERE role = 'user' AND trim(content) <> '' GROUP BY 1),
        x AS (SELECT r.session_id, max(CASE WHEN n = last THEN content END) AS signal_text, bool_or(n = last AND good) AS g, max(CASE WHEN n < last AND coalesce(error, '') <> '' THEN n END) AS e, max(CASE WHEN n < last AND good THEN n END) AS p FROM r JOIN l ON l.session_id = r.session_id GROUP BY 1)
        SELECT session_id, signal_text FROM x WHERE g AND (e IS NULL OR p > e)""",
    ),
    "passive_signals": (
        lambda s, d: o.passive_signals(_said(s, d), 3 * 3600).select("id", "passive_signal"),
        f"""WITH {TRACE}, a AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS message FROM t), c AS (SELECT * FROM a WHERE tool_name IS NOT NULL),
        g AS (SELECT id, session_id, ts, CASE WHEN {' OR '.join(f"starts_with(lower(trim(coalesce(message, ''))), '{p}')" for p in t.PREFIXES)} THEN 'correction' WHEN lag(tool_name) OVER w = tool_name AND date_diff('microsecond', lag(ts) OVER w, ts) <= 10800000000 THEN 'undo'
         WHEN {' OR '.join(f"coalesce(lag(message, {i}) OVER w = message AND lag(tool_name, {i}) OVER w <> tool_name, false)" for i in range(1, 5))} THEN 're_invocation' END AS sg FROM c WINDOW w AS (PARTITION BY session_id ORDER BY ts, id))
        SELECT id, lead(sg) OVER {W}) AS passive_signal FROM g""",
    ),
    "session_snapshots": (
        lambda s, d: o.snapshots_of_sessions(trace(s, d), trace(s, d).where("session_id % 3 = 0").select("session_id").distinct()),
        f"WITH {TRACE} SELECT session_id, count(tool_name) AS tool_call_count, count(*) FILTER (WHERE coalesce(error, '') <> '' AND NOT {NOISE}) AS error_count, count(*) FILTER (WHERE role = 'user' AND {GOOD}) AS positive_signal_count FROM t WHERE session_id % 3 > 0 GROUP BY 1",
    ),
    "facet_error_area": (
        lambda s, d: o.error_area(o.error_records(trace(s, d)), "command_category"),
        f"WITH {ERRORS}, a AS (SELECT session_id, command_category AS area, count(*) AS n, min({{'t': ts, 'i': id}}) AS f FROM e GROUP BY 1, 2) SELECT session_id, area, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) AS r FROM a) WHERE r = 1",
    ),
    "facets_bundle": (
        _facets,
        f"""WITH {ERRORS}, k AS (SELECT session_id, sha256(string_agg(h, '' ORDER BY h)) AS key FROM (SELECT session_id, sha256(concat_ws('|', CAST(id AS VARCHAR), role, tool_name, content, error)) AS h FROM t) GROUP BY 1),
        m AS (SELECT session_id, count(DISTINCT tool_name) AS n, avg(CASE WHEN coalesce(error, '') <> '' THEN 0.0::DOUBLE ELSE 1.0 END) AS r FROM t WHERE tool_name IS NOT NULL GROUP BY 1),
        a0 AS (SELECT session_id, command_category AS area, count(*) AS n, min({{'t': ts, 'i': id}}) AS f FROM e GROUP BY 1, 2), a AS (SELECT session_id, area FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, f) AS r FROM a0) WHERE r = 1),
        c0 AS (SELECT session_id, coalesce(content, '') AS c, {t.hits_sql('content', t.POSITIVE)} AS p, {t.negatives_sql('content')} AS n FROM t WHERE role = 'user'),
        c AS (SELECT session_id, round(count(*) * ln(greatest(sum(length(c)), 1)), 6) AS sc, avg((p - n)::DOUBLE / greatest(p + n, 1)) AS mean FROM c0 GROUP BY 1)
        SELECT k.session_id, key, CASE WHEN n >= 5 AND r >= 0.8 THEN 'high' WHEN n >= 3 AND r >= 0.5 THEN 'medium' WHEN n IS NOT NULL THEN 'low' END AS mastery, area,
        CASE WHEN sc < 50 THEN 'simple' WHEN sc < 200 THEN 'moderate' WHEN sc IS NOT NULL THEN 'complex' END AS band, CASE WHEN mean > 0.3 THEN 'satisfied' WHEN mean < -0.3 THEN 'unsatisfied' WHEN mean IS NOT NULL THEN 'neutral' END AS mood
        FROM k LEFT JOIN m ON m.session_id = k.session_id LEFT JOIN a ON a.session_id = CAST(k.session_id AS VARCHAR) LEFT JOIN c ON c.session_id = k.session_id""",
    ),
}
