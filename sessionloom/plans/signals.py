"""Queries over signals."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import signals as g
from sessionloom.sources.bind import DIALOGUE, STREAM, TALK, dialogue, table, talk, tool_stream

W = "(PARTITION BY session_id ORDER BY ts, id)"
WI = "(PARTITION BY session_id ORDER BY idx"
PN = f"{t.hits_sql('content', t.POSITIVE)} AS p, {t.negatives_sql('content')} AS n"


def _corpus(s, d):
    return table(s, d, "documents").select(F.col("doc_id"), F.col("text").alias("content"), "source", "lang")


QUERIES = {
    "correction_messages": (
        lambda s, d: g.corrections(talk(s, d)).select("session_id", "idx"),
        f"WITH {TALK} SELECT session_id, idx FROM m WHERE role IN ('user', 'human') AND ({t.any_of_sql('content', t.CORRECTION)} OR regexp_matches(content, '(?i)(^|\\s)no,'))",
    ),
    "undo_messages": (
        lambda s, d: g.undos(talk(s, d)).select("session_id", "idx"),
        f"WITH {TALK}, c AS (SELECT session_id, idx, role, regexp_replace(content, '(?i)git\\s+push', '', 'g') AS content FROM m) SELECT session_id, idx FROM c WHERE role IN ('user', 'human') AND {t.any_of_sql('content', t.UNDO)}",
    ),
    "admission_messages": (
        lambda s, d: g.admissions(talk(s, d)).select("session_id", "idx", "snippet"),
        f"WITH {TALK} SELECT session_id, idx, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM m WHERE role = 'assistant' AND {t.any_of_sql('content', t.ADMISSION)}",
    ),
    "agent_state_multilabel": (
        lambda s, d: g.labels(talk(s, d), "content").groupBy("role", "label").agg(F.count("*").alias("n")),
        f"WITH {TALK}, l AS (" + " UNION ALL ".join(f"SELECT role, '{n}' AS label FROM m WHERE {t.any_of_sql('content', p)}" for n, p in t.STATES) + ") SELECT role, label, count(*) AS n FROM l GROUP BY 1, 2",
    ),
    "sentiment_scores": (
        lambda s, d: g.sentiments(_corpus(s, d)).select("doc_id", "score"),
        f"WITH c AS (SELECT doc_id, {t.hits_sql('text', t.POSITIVE)} AS p, {t.negatives_sql('text')} AS n FROM documents) SELECT doc_id, round((p - n)::DOUBLE / greatest(p + n, 1), 6) AS score FROM c",
    ),
    "frustration_streak": (
        lambda s, d: g.frustration(talk(s, d)).select("session_id", "idx", "streak", "escalated"),
        f"WITH {TALK}, c AS (SELECT *, {PN} FROM m WHERE role = 'user'), x AS (SELECT *, (p - n)::DOUBLE / greatest(p + n, 1) AS sc FROM c) SELECT session_id, idx, coalesce(sc < 0 AND lag(sc, 1) OVER {WI}) < 0 AND lag(sc, 2) OVER {WI}) < 0, false) AS streak, {t.escalated_sql('content')} AS escalated FROM x",
    ),
    "positive_signals": (
        lambda s, d: g.positives(talk(s, d)).select("session_id", "idx", "kind"),
        f"""WITH {TALK}, c AS (SELECT *, {PN}, coalesce(max(role = 'assistant') OVER {WI} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prior FROM m)
        SELECT session_id, idx, CASE WHEN {t.any_of_sql('content', t.CONFIRMATION)} THEN 'confirmation' WHEN {t.any_of_sql('content', t.GRATITUDE)} THEN 'gratitude'
        WHEN prior AND len(regexp_extract_all(content, '\\S+')) < 20 AND p > 0 AND n = 0 THEN 'implicit_approval' END AS kind FROM c WHERE role = 'user'""",
    ),
    "session_context_lag_lead": (
        lambda s, d: g.neighbours(dialogue(s, d)).select("session_id", "idx", "before", "after", "last_user", "last_assistant"),
        f"""WITH {DIALOGUE} SELECT session_id, idx, lag(content) OVER {WI}) AS before, lead(content) OVER {WI}) AS after,
        last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER {WI} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user,
        last_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER {WI} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_assistant FROM m""",
    ),
    "repeated_attempt_third": (
        lambda s, d: g.repeated_attempts(tool_stream(s, d), "purchase").select("id", "session_id", "tool"),
        f"""WITH {STREAM}, i AS (SELECT *, CASE WHEN coalesce(lag(tool) OVER {W}, '') <> tool THEN 1 ELSE 0 END AS f FROM s), j AS (SELECT *, sum(f) OVER {W} AS run FROM i),
        k AS (SELECT *, row_number() OVER (PARTITION BY session_id, run ORDER BY ts, id) AS n FROM j) SELECT id, session_id, tool FROM k WHERE n = 3 AND tool <> 'purchase'""",
    ),
    "quick_redo_within_6h": (
        lambda s, d: g.quick_redo(tool_stream(s, d), 21600).select("id", "session_id", "tool"),
        f"WITH {STREAM}, i AS (SELECT *, lag(tool) OVER {W} AS pt, lag(ts) OVER {W} AS pts FROM s) SELECT id, session_id, tool FROM i WHERE pt = tool AND date_diff('microsecond', pts, ts) <= 21600000000",
    ),
    "reinvocation_lag4": (
        lambda s, d: g.reinvoked(tool_stream(s, d)).select("id", "session_id", "tool", "k"),
        f"WITH {STREAM}, i AS (SELECT *, " + ", ".join(f"lag(k, {i}) OVER {W} AS k{i}, lag(tool, {i}) OVER {W} AS t{i}" for i in range(1, 5)) + " FROM s) SELECT id, session_id, tool, k FROM i WHERE " + " OR ".join(f"coalesce(k{i} = k AND t{i} <> tool, false)" for i in range(1, 5)),
    ),
    "approval_rates": (
        lambda s, d: g.approvals(tool_stream(s, d), "purchase"),
        f"""WITH {STREAM}, i AS (SELECT *, first_value(CASE WHEN tool = 'purchase' THEN k % 3 = 0 END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS no FROM s)
        SELECT tool, count(*) FILTER (WHERE NOT coalesce(no, false)) AS approved, count(*) FILTER (WHERE no) AS rejected, round(count(*) FILTER (WHERE NOT coalesce(no, false))::DOUBLE / count(*), 6) AS rate FROM i WHERE tool <> 'purchase' GROUP BY tool""",
    ),
    "session_metrics": (
        lambda s, d: g.session_metrics(tool_stream(s, d)),
        f"""WITH {STREAM}, a AS (SELECT session_id, tool, count(*) AS n, sum(amount) AS a, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1, 2)
        SELECT session_id, CAST(sum(n) AS BIGINT) AS calls, round(sum(a), 4) AS amount, CAST(sum(CASE WHEN tool = 'error' THEN n ELSE 0 END) AS BIGINT) AS errors,
        CAST(floor(date_diff('microsecond', min(lo), max(hi)) / 1e6) AS BIGINT) AS seconds, arg_max(tool, {{'n': n, 't': tool}}) AS modal_tool, string_agg(tool || '=' || n, ',' ORDER BY tool || '=' || n) AS by_tool FROM a GROUP BY 1""",
    ),
    "dedup_first_per_key": (
        lambda s, d: g.first_per_key(tool_stream(s, d), ["session_id", "tool", "k"], ["ts", "id"]).select("id"),
        f"WITH {STREAM} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, tool, k ORDER BY ts, id) AS r FROM s) WHERE r = 1 OR session_id IS NULL OR tool IS NULL OR k IS NULL",
    ),
    "cross_format_antijoin": (
        lambda s, d: g.new_only(_corpus(s, d).withColumnRenamed("content", "text"), table(s, d, "benchmark"), ["text"], ["doc_id"]).select("doc_id"),
        "SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) GROUP BY text",
    ),
    "facet_tool_mastery": (
        lambda s, d: g.tool_mastery(tool_stream(s, d)),
        f"WITH {STREAM}, a AS (SELECT session_id, count(DISTINCT tool) AS tools, avg(CASE WHEN is_error THEN 0.0::DOUBLE ELSE 1.0 END) AS r FROM s GROUP BY 1) SELECT session_id, tools, CASE WHEN tools >= 5 AND r >= 0.8 THEN 'high' WHEN tools >= 3 AND r >= 0.5 THEN 'medium' ELSE 'low' END AS mastery, round(r, 6) AS rate FROM a",
    ),
    "facet_complexity": (
        lambda s, d: g.complexity(dialogue(s, d)),
        f"""WITH {DIALOGUE}, c AS (SELECT *, {PN} FROM m), a AS (SELECT session_id, count(*) AS messages, CAST(sum(length(content)) AS BIGINT) AS tokens, avg((p - n)::DOUBLE / greatest(p + n, 1)) AS mean FROM c GROUP BY 1),
        b AS (SELECT *, round(messages * ln(greatest(tokens, 1)), 6) AS score FROM a) SELECT session_id, messages, tokens, score, CASE WHEN score < 50 THEN 'simple' WHEN score < 200 THEN 'moderate' ELSE 'complex' END AS band, CASE WHEN mean > 0.3 THEN 'satisfied' WHEN mean < -0.3 THEN 'unsatisfied' ELSE 'neutral' END AS mood FROM b""",
    ),
    "pii_scrub": (
        lambda s, d: _corpus(s, d).select("doc_id", F.md5(t.scrubbed(F.col("content"))).alias("digest")),
        f"SELECT doc_id, md5({t.scrubbed_sql('text')}) AS digest FROM documents",
    ),
}
