"""Queries that put the conversations into the formats of the stores and read them back through the parsers."""

from pyspark.sql import functions as F

from sessionloom.sources import agents, markdown
from sessionloom.sources.bind import dialogue

PATTERN, TERMS = r"[ ,]que[ .,]|password", ("tion", "the")


def _lines(d, file, value):
    return d.select(file.alias("file"), F.col("idx").cast("int").alias("line"), F.to_json(value).alias("value"))


def _blocks():
    return F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text")))


def records(s, d):
    """Each sixth of the conversations in one agent's format, parsed and unioned."""
    m = dialogue(s, d).withColumn("sid", F.col("session_id").cast("string"))
    part = [m.where(F.col("session_id") % 6 == k) for k in range(6)]
    at = F.col("idx") + 1704067200
    ts = F.timestamp_seconds(at)
    claude = _lines(part[0], F.concat(F.lit("/c/"), "sid", F.lit(".jsonl")), F.struct(F.col("role").alias("type"), ts.alias("timestamp"), F.struct("role", _blocks().alias("content")).alias("message")))
    kimi = _lines(part[1], F.concat(F.lit("/k/"), "sid", F.lit("/agents/main/wire.jsonl")), F.struct(F.lit("context.append_message").alias("type"), (at * 1000).alias("time"), F.struct("role", _blocks().alias("content")).alias("message")))
    chain = _lines(part[2], F.concat(F.lit("/p/"), "sid", F.lit("/messages.jsonl")), F.struct("role", "content", at.cast("string").alias("timestamp")))
    goose = part[3].select(F.col("sid").alias("session_id"), "role", F.to_json(_blocks()).alias("content_json"), at.alias("created_timestamp"), F.col("idx").alias("message_id"))
    key = F.concat("sid", F.lit("-"), F.col("idx").cast("string"))
    message = part[4].select(key.alias("id"), F.to_json(F.struct("role")).alias("data"))
    parts = part[4].select(key.alias("id"), key.alias("message_id"), F.col("sid").alias("session_id"), F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("data"), (at * 1000).alias("time_created"))
    said = F.struct("idx", F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role")).alias("type"), "content", ts.alias("timestamp"))
    gemini = part[5].groupBy("sid").agg(F.array_sort(F.collect_list(said)).alias("messages")).select(F.concat(F.lit("/g/session-"), "sid", F.lit(".json")).alias("file"), F.to_json(F.struct(F.col("sid").alias("sessionId"), "messages")).alias("value"))
    return agents.fan_in(agents.scan_claude(claude), agents.scan_kimi(kimi), agents.scan_promptchain(chain), agents.scan_goose(goose), agents.scan_opencode(message, parts), agents.scan_gemini(gemini))


def _markdown(s, d):
    head = F.when(F.col("role") == "user", "**Human:** ").otherwise("**Assistant:** ")
    turn = F.concat(head, F.col("content"), F.lit('\n[Tool call: Read with input {"turn": '), F.col("idx").cast("string"), F.lit("}]\n[Tool output: done]"))
    files = dialogue(s, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", turn.alias("t")))).alias("a"))
    files = files.select(F.col("session_id").cast("string").alias("file"), F.array_join(F.transform("a", lambda x: x["t"]), "\n---\n").alias("value"))
    return markdown.flattened(markdown.turns(files)).select("file", "turn", "call", "role", F.md5("content").alias("content_md5"), "tool_name", "tool_input", "tool_output", "error")


RECORDS = """r AS (SELECT ['claude', 'kimi', 'promptchain', 'goose', 'opencode', 'gemini'][conv_id % 6 + 1] AS agent, CAST(conv_id AS VARCHAR) AS session_id, 1704067200 + turn AS second, role, text FROM conversations)"""

QUERIES = {
    "agent_records": (
        lambda s, d: records(s, d).select("agent", "session_id", F.unix_seconds("ts").alias("second"), "role", F.md5("content").alias("content_md5")),
        f"WITH {RECORDS} SELECT agent, session_id, second, role, md5(substr(text, 1, 2000)) AS content_md5 FROM r",
    ),
    "agent_search": (
        lambda s, d: agents.search(records(s, d), PATTERN, TERMS).select("agent", "session_id", F.unix_seconds("ts").alias("second"), "role"),
        rf"WITH {RECORDS} SELECT agent, session_id, second, role FROM r WHERE regexp_matches(text, '(?i){PATTERN}') AND regexp_matches(lower(text), '{'|'.join(TERMS)}')",
    ),
    "agent_hit_counts": (
        lambda s, d: agents.search(records(s, d), PATTERN).groupBy("agent").agg(F.count("*").alias("hits"), F.countDistinct("session_id").alias("sessions"), F.unix_seconds(F.max("ts")).alias("newest")),
        f"WITH {RECORDS} SELECT agent, count(*) AS hits, count(DISTINCT session_id) AS sessions, max(second) AS newest FROM r WHERE regexp_matches(text, '(?i){PATTERN}') GROUP BY 1",
    ),
    "markdown_turns": (
        _markdown,
        r"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, turn AS idx, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, text FROM conversations),
        b AS (SELECT *, text || chr(10) || '[Tool call: Read with input {"turn": ' || idx || '}]' || chr(10) || '[Tool output: done]' AS body FROM t)
        SELECT file, turn, -1 AS call, role, md5(body) AS content_md5, NULL AS tool_name, NULL AS tool_input, NULL AS tool_output, NULL AS error FROM b
        UNION ALL SELECT file, turn, 0, 'assistant', NULL, 'Read', '{"turn": ' || idx || '}', 'done', NULL FROM b""",
    ),
}
