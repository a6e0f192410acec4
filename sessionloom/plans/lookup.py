"""Queries over files, handles and hits."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from sessionloom.operators import lookup as o
from sessionloom.operators import mining
from sessionloom.plans.mining import ERRORS
from sessionloom.plans.stores import RECORDS, records
from sessionloom.sources.bind import TRACE, trace

NOW = datetime(2024, 1, 29, tzinfo=timezone.utc)
PATHS = ("/home/u/.codex/s/", "/home/u/goose/sessions/", "/home/u/.claude/projects/-x/", "/home/u/.kimi-code/a/b/", "/srv/opencode/x/", "/home/u/.gemini/t/", "/srv/app/.aider.chat/")
PATH = "([" + ", ".join(f"'{p}'" for p in PATHS) + f"])[id % {len(PATHS)} + 1] || CASE WHEN id % {len(PATHS)} = 3 THEN session_id || '/x/y/wire.jsonl' ELSE session_id || '.jsonl' END"
HANDLE = "CASE id % 5 WHEN 0 THEN 'goose:' WHEN 1 THEN 'claude:' WHEN 2 THEN 'codex:' ELSE '' END || CAST(session_id AS VARCHAR)"
GET = lambda n: f"CASE WHEN json_valid(tool_input) THEN json_extract_string(tool_input, '$.{n}') END"
NEEDLE = "needle|app1|pytest|continue"


def _paths(s, d):
    return trace(s, d).withColumn("path", F.expr(f"concat(element_at(array({', '.join(repr(p) for p in PATHS)}), CAST(id % {len(PATHS)} + 1 AS INT)), CAST(session_id AS STRING), CASE WHEN id % {len(PATHS)} = 3 THEN '/x/y/wire.jsonl' ELSE '.jsonl' END)"))


def _handled(s, d):
    return trace(s, d).withColumn("session_id", F.expr("concat(CASE id % 5 WHEN 0 THEN 'goose:' WHEN 1 THEN 'claude:' WHEN 2 THEN 'codex:' ELSE '' END, CAST(session_id AS STRING))"))


def _lines(s, d):
    md = F.when(F.col("role") == "user", "**Human:** x").when(F.col("id") % 3 == 0, "---").otherwise(F.concat(F.lit("Tool call: "), "tool_name"))
    js = F.when(F.col("role") == "user", '{"type": "user"}').otherwise('{"type": "tool_use"}')
    even = F.col("session_id") % 2 == 0
    return trace(s, d).where("amount > 30").select(F.concat(F.col("session_id").cast("string"), F.when(even, ".jsonl").otherwise(".md")).alias("path"), F.when(even, js).otherwise(md).alias("line"))


def _files(s, d):
    return trace(s, d).groupBy(F.col("source_file").alias("path")).agg(F.count("*").alias("size"), F.max("k").alias("mtime"))


def _state(s, d):
    return trace(s, d).where("session_id % 3 > 0").groupBy(F.col("source_file").alias("path")).agg(F.sum(F.when(F.col("k") < 60, 2).otherwise(0)).alias("offset"), (F.max("k") + F.max(F.col("session_id")) % 3).alias("seen_mtime"))


def _csv(s, d):
    e = mining.error_records(trace(s, d)).select("id", "session_id", "ts", "error_type", "tool_name", "error_text")
    return o.hop1_rows(e.select(F.from_csv(F.to_csv(F.struct(*e.columns), FORMAT), o.HOP1, FORMAT).alias("r")).select("r.*"))


FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
AGENT_NAMES = ("aider", "claude", "codex", "gemini", "goose", "kimi", "opencode", "promptchain")

QUERIES = {
    "errors_since": (
        lambda s, d: mining.error_records(trace(s, d)).where(F.col("ts") >= F.lit(o.parse_since("2 weeks ago", NOW).replace(tzinfo=None)).cast("timestamp")).select("id", "ts"),
        f"WITH {ERRORS} SELECT id, ts FROM e WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
    ),
    "project_sessions": (
        lambda s, d: trace(s, d).where(o.in_project(F.col("source_file"), "APP", True)).groupBy("source_file").agg(F.count("*").alias("n"), F.bool_or(o.of_session(F.col("source_file"), "12")).alias("asked_for")),
        f"WITH {TRACE} SELECT source_file, count(*) AS n, bool_or(regexp_extract(source_file, '([^/]*)\\.jsonl$', 1) = '12') AS asked_for FROM t WHERE contains(lower(source_file), 'app') GROUP BY 1",
    ),
    "file_admission": (
        lambda s, d: o.admitted(_lines(s, d), 5, 2),
        f"""WITH {TRACE}, l AS (SELECT session_id % 2 = 0 AS js, session_id || CASE WHEN session_id % 2 = 0 THEN '.jsonl' ELSE '.md' END AS path, role = 'user' AS u, id % 3 = 0 AS sep FROM t WHERE amount > 30),
        a AS (SELECT path, js, count(*) FILTER (WHERE js OR u OR sep) AS m, count(*) FILTER (WHERE CASE WHEN js THEN NOT u ELSE NOT u AND NOT sep END) AS tool_calls FROM l GROUP BY 1, 2), b AS (SELECT path, CASE WHEN NOT js AND m > 0 THEN m + 1 ELSE m END AS messages, tool_calls FROM a)
        SELECT *, messages >= 5 AND tool_calls >= 2 AS passes FROM b""",
    ),
    "read_offsets": (
        lambda s, d: o.offsets(_files(s, d), _state(s, d)),
        f"""WITH {TRACE}, f AS (SELECT source_file AS path, count(*) AS size, max(k) AS mtime FROM t GROUP BY 1), st AS (SELECT source_file AS path, CAST(sum(CASE WHEN k < 60 THEN 2 ELSE 0 END) AS BIGINT) AS off, max(k) + max(session_id) % 3 AS sm FROM t WHERE session_id % 3 > 0 GROUP BY 1),
        x AS (SELECT f.*, off, coalesce(size < off OR mtime < sm - 1, false) AS was_reset FROM f LEFT JOIN st ON st.path = f.path) SELECT path, size, CASE WHEN off IS NULL OR was_reset THEN 0 ELSE off END AS start, was_reset, CASE WHEN off IS NULL OR was_reset THEN 0 ELSE off END < size AS has_new FROM x""",
    ),
    "handles_of_paths": (
        lambda s, d: _paths(s, d).select("path", o.handle_of_path(F.col("path")).alias("handle")).distinct(),
        f"""WITH {TRACE}, p AS (SELECT DISTINCT {PATH} AS path, id % 7 AS m, session_id FROM t) SELECT path, (['codex', 'goose', 'claude', 'kimi', 'opencode', 'gemini', 'aider'])[m + 1] || ':' || session_id AS handle FROM p""",
    ),
    "session_forms": (
        lambda s, d: _handled(s, d).where(o.same_session(F.col("session_id"), "goose:12")).groupBy("session_id").agg(F.count("*").alias("n")),
        f"WITH {TRACE}, h AS (SELECT {HANDLE} AS session_id FROM t) SELECT session_id, count(*) AS n FROM h WHERE session_id IN ('12', 'goose:12') GROUP BY 1",
    ),
    "session_prefixes": (
        lambda s, d: o.resolved(_handled(s, d), "1"),
        f"WITH {TRACE}, h AS (SELECT {HANDLE} AS session_id FROM t) SELECT DISTINCT session_id FROM h WHERE session_id LIKE '1%' OR session_id LIKE '%:1%'",
    ),
    "sessions_backfilled": (
        lambda s, d: o.backfilled(_handled(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
        f"WITH {TRACE}, h AS (SELECT {HANDLE} AS session_id FROM t) SELECT CASE WHEN contains(session_id, ':') THEN session_id ELSE 'claude:' || session_id END AS session_id, count(*) AS n FROM h GROUP BY 1",
    ),
    "hop1_csv": (
        _csv,
        f"WITH {ERRORS} SELECT id, session_id, ts, error_type, tool_name, error_text, '' AS context_before, '' AS context_after, '' AS tool_input FROM e",
    ),
    "recent_files": (
        lambda s, d: o.files_of(o.recent(trace(s, d).where("error is not null"), F.lit(NOW.replace(tzinfo=None)).cast("timestamp"), 7)),
        f"WITH {TRACE} SELECT DISTINCT source_file FROM t WHERE error IS NOT NULL AND ts >= TIMESTAMP '2024-01-22 00:00:00'",
    ),
    "hit_categories": (
        lambda s, d: o.categorised(trace(s, d), NEEDLE),
        rf"""WITH {TRACE}, j AS (SELECT *, coalesce(nullif({GET('file_path')}, ''), nullif({GET('path')}, ''), {GET('notebook_path')}) AS p, {GET('command')} AS c FROM t),
        r AS (SELECT *, CASE WHEN regexp_matches(content, '(?i){NEEDLE}') THEN 0 WHEN regexp_matches(p, '(?i){NEEDLE}') THEN 1 WHEN regexp_matches(c, '(?i){NEEDLE}') AND NOT regexp_matches(c, '{o.SEARCHES}') THEN 2 WHEN regexp_matches(output, '(?i){NEEDLE}') THEN 3 END AS rk FROM j),
        x AS (SELECT *, substr(trim(regexp_replace(CASE rk WHEN 0 THEN content WHEN 1 THEN p WHEN 2 THEN c ELSE output END, '\s+', ' ', 'g')), 1, 160) AS sn FROM r WHERE rk IS NOT NULL)
        SELECT session_id, (['discussed', 'edited', 'command', 'output'])[min(rk) + 1] AS label, count(*) AS hits, max(ts) AS latest, arg_min(sn, {{'k': rk, 't': ts, 'i': id}}) AS snippet FROM x GROUP BY 1""",
    ),
    "noise_hint": (
        lambda s, d: o.noise_hint(mining.error_records(trace(s, d)).where(F.contains("error_text", F.lit("file")))),
        f"WITH {ERRORS} SELECT count(*) AS n, CASE WHEN count(*) > 20 THEN count(*) || ' hits: refine with a second set of terms' ELSE '' END AS hint FROM e WHERE contains(error_text, 'file')",
    ),
    "session_transcripts": (
        lambda s, d: o.expanded(trace(s, d)).select("session_id", "n", F.md5("transcript").alias("transcript_md5")),
        f"WITH {TRACE} SELECT session_id, count(*) AS n, md5(string_agg('[' || role || '] ' || coalesce(nullif(content, ''), concat_ws(' ', tool_name, tool_input)), chr(10) ORDER BY ts, id)) AS transcript_md5 FROM t GROUP BY 1",
    ),
    "agent_inventory": (
        lambda s, d: o.inventory(records(s, d), AGENT_NAMES).withColumn("latest", F.unix_seconds("latest")),
        f"WITH {RECORDS}, a AS (SELECT unnest({list(AGENT_NAMES)}) AS agent), c AS (SELECT agent, count(*) AS n, max(second) AS latest FROM r GROUP BY 1) SELECT a.agent, n IS NOT NULL AS present, coalesce(n, 0) AS n, latest FROM a LEFT JOIN c ON c.agent = a.agent",
    ),
    "errors_of_agent": (
        lambda s, d: o.fetched(mining.error_records(_handled(s, d)), agent="claude", kind="tool_failure", tool="Bash", since="2024-01-10 00:00:00", project="app").select("id", "session_id", "tool_name"),
        f"""WITH {ERRORS.replace("t AS (SELECT", "t0 AS (SELECT", 1)}""".replace("), e0 AS", f"), t AS (SELECT t0.* REPLACE ({HANDLE} AS session_id) FROM t0), e0 AS", 1)
        + " SELECT e.id, e.session_id, e.tool_name FROM e JOIN t ON t.id = e.id WHERE NOT starts_with(e.session_id, 'goose:') AND NOT starts_with(e.session_id, 'codex:') AND e.tool_name = 'Bash' AND e.ts >= TIMESTAMP '2024-01-10 00:00:00' AND contains(lower(source_file), 'app')",
    ),
    "unlabelled_queue": (
        lambda s, d: o.unlabelled(trace(s, d).where("tool_name is not null"), s.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("id"))).select("id", "tool_name", "place"),
        f"WITH {TRACE} SELECT id, tool_name, CAST(row_number() OVER (PARTITION BY tool_name ORDER BY ts, id) AS INTEGER) AS place FROM t WHERE tool_name IS NOT NULL AND id NOT IN (SELECT doc_id FROM labels)",
    ),
}
