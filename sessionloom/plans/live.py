"""Queries over streams."""

import uuid

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.store import shared_dir
from sessionloom.plans import curation, mining
from sessionloom.sources import tail
from sessionloom.sources.bind import STREAM, TALK, table
from sessionloom.streaming import live, state


def _tailed(s, d):
    """The conversations as growing JSONL files, read in two runs of one stream; the second goes on at the first one's checkpoint."""
    at = f"{shared_dir(s)}/tail-{uuid.uuid4().hex}"
    rows = table(s, d, "conversations")
    for early in (True, False):
        part = rows.where((F.col("turn") < 3) == early)
        part.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.mode("append").text(f"{at}/lines")
        q = tail.read_appended(s, f"{at}/lines", glob="part-*").writeStream.option("checkpointLocation", f"{at}/state").format("parquet").option("path", f"{at}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    value = F.from_json("value", "conv_id long, turn int, role string, text string")
    out = s.read.parquet(f"{at}/out").select(value.alias("v"))
    return out.groupBy("v.role").agg(F.count("*").alias("n"), F.count_distinct("v.conv_id").alias("conversations"), F.sum(F.char_length("v.text")).alias("chars"), F.max("v.turn").alias("last_turn"))


def _prompts(s, d):
    m = live.talk_stream(s, d).where("role = 'user'").withColumn("id", F.col("idx").cast("long"))
    out = live.finished(state.prompt_state(m), "append", ["session_id", "id"], keyed=True)
    mean = F.round(F.aggregate("recent", F.lit(0.0), lambda x, y: x + y) / F.size("recent"), 6)
    return out.select("session_id", F.col("id").alias("idx"), "corrections", "undos", "streak", F.size("recent").cast("long").alias("n_recent"), mean.alias("recent_mean"), "frustrated")


LOW = "lower(trim(coalesce(content, '')))"
UNDOING = " OR ".join(f"contains({LOW}, '{w}')" for w in t.UNDOING)
CORRECTING = " OR ".join(f"starts_with({LOW}, '{w.replace(chr(39), chr(39) * 2)}')" for w in t.CORRECTING)

QUERIES = {
    "stream_digest": (
        lambda s, d: live.finished(live.digest(live.event_stream(s, d)), "complete", ["tool"]),
        f"WITH {STREAM} SELECT tool, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors, max(ts) AS cursor FROM s GROUP BY 1",
    ),
    "stream_filtered_digest": (
        lambda s, d: live.finished(live.digest(live.live_filter(live.event_stream(s, d), ["view", "error"], "2024-01-05 00:00:00", "2024-01-20 00:00:00")), "complete", ["tool"]),
        f"WITH {STREAM} SELECT tool, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors, max(ts) AS cursor FROM s WHERE tool IN ('view', 'error') AND ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1",
    ),
    "stream_finalised_sessions": (
        lambda s, d: live.finished(live.finalised(live.event_stream(s, d)), "append", ["session_id", "start"]),
        f"""WITH {STREAM}, i AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM s), j AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM i)
        SELECT session_id, min(ts) AS start, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors FROM j GROUP BY session_id, g HAVING max(ts) + INTERVAL 12 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM s)) - INTERVAL 1 HOUR""",
    ),
    "stream_session_state": (
        lambda s, d: live.finished(state.session_counts(live.event_stream(s, d)), "update", ["session_id"], keyed=True),
        f"""WITH {STREAM}, i AS (SELECT *, sum(CAST(NOT is_error AS INTEGER)) OVER (PARTITION BY session_id ORDER BY ts, id) AS g FROM s), r AS (SELECT session_id, g, count(*) FILTER (WHERE is_error) AS c FROM i GROUP BY 1, 2),
        l AS (SELECT session_id, max(c) AS longest FROM r GROUP BY 1) SELECT s.session_id, count(*) AS events, count(*) FILTER (WHERE is_error) AS errors, min(longest) AS longest FROM s JOIN l ON l.session_id = s.session_id GROUP BY 1""",
    ),
    "stream_tail": (
        _tailed,
        "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars, max(turn) AS last_turn FROM conversations GROUP BY 1",
    ),
    "stream_prompt_state": (
        _prompts,
        f"""WITH {TALK}, u AS (SELECT session_id, idx, CASE WHEN {UNDOING} THEN 'undo' WHEN {CORRECTING} THEN 'correction' END AS kind, {t.hits_sql('content', t.POSITIVE)} AS p, {t.negatives_sql('content')} AS n
         FROM m WHERE role = 'user' AND trim(coalesce(content, '')) <> ''), c AS (SELECT *, (p - n)::DOUBLE / greatest(p + n, 1) AS score FROM u),
        g AS (SELECT *, count(*) FILTER (WHERE score >= 0) OVER w AS run FROM c WINDOW w AS (PARTITION BY session_id ORDER BY idx)),
        k AS (SELECT *, count(*) FILTER (WHERE score < 0) OVER (PARTITION BY session_id, run ORDER BY idx) AS streak FROM g)
        SELECT session_id, CAST(idx AS BIGINT) AS idx, count(*) FILTER (WHERE kind = 'correction') OVER w AS corrections, count(*) FILTER (WHERE kind = 'undo') OVER w AS undos, streak,
         count(*) OVER r AS n_recent, round(avg(score) OVER r, 6) AS recent_mean, streak >= 3 AND count(*) FILTER (WHERE streak >= 3) OVER w = 1 AS frustrated
        FROM k WINDOW w AS (PARTITION BY session_id ORDER BY idx), r AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ),
    "stream_passive_signals": (
        lambda s, d: live.finished(state.call_signals(live.trace_stream(s, d), 3 * 3600), "append", ["session_id", "id"], keyed=True).select("id", "passive_signal"),
        f"SELECT * FROM ({mining.QUERIES['passive_signals'][1]}) WHERE passive_signal IS NOT NULL",
    ),
    "stream_logged_calls": (
        lambda s, d: live.finished(state.logged_calls(live.event_stream(s, d), 6 * 3600), "append", ["session_id", "id"], keyed=True),
        f"""WITH RECURSIVE {STREAM}, n AS (SELECT id, session_id, tool, row_number() OVER (PARTITION BY session_id, tool ORDER BY ts, id) AS i,
         1 + count(*) OVER (PARTITION BY session_id, tool ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '5 hours 59 minutes 59.999999 seconds' FOLLOWING) AS next FROM s),
        k AS (SELECT * FROM n WHERE i = 1 UNION ALL SELECT n.* FROM k JOIN n ON n.session_id = k.session_id AND n.tool = k.tool AND n.i = k.next) SELECT session_id, id, tool FROM k""",
    ),
    "stream_search_feedback": (
        lambda s, d: live.finished(state.search_feedback(live.event_stream(s, d), F.col("tool").isin("view", "click"), F.col("tool") == "view", F.col("is_error"), 6 * 3600), "append", ["session_id", "id"], keyed=True),
        curation.QUERIES["search_feedback"][1],
    ),
}
