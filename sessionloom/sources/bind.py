"""Bindings of the driver's tables to the session model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tool_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool calls: id, session_id, tool, ts, amount, k, is_error."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), "ts", F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("event_type") == "error").alias("is_error"),
    )


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: session_id, idx, role, content."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"))


#: The same in SQL.
STREAM = (
    "s AS (SELECT event_id AS id, user_id AS session_id, event_type AS tool, ts, value AS amount, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type = 'error' AS is_error FROM events)"
)
DIALOGUE = "m AS (SELECT conv_id AS session_id, turn AS idx, role, text AS content FROM conversations)"


# The given prose is invented, so that no phrase of a lexicon occurs in it.  The two bindings below put such
# phrases, tools, inputs and outputs beside each given row, chosen by its own numbers.
SAY = (
    "no, actually use the other file", "undo that please", "thanks a lot for this", "yes exactly", "this is wrong, try again", "looks fine, go on", "stop doing that", "what a waste of time",
    "great work", "please continue with the next step of the plan", "never mind!!", "why does this happen??", "roll back the last change", "perfect, it works", "wait, not that", "", "   ", "ok",
    "I meant the other path", "just do it now", "stop.", "nice one, ship it",
)
REPLY = (
    "I made a mistake there", "I think it might be the cache", "it must be the lock, definitely", "on reflection, my previous attempt failed because of the port", "let me verify the result",
    "presumably the table is empty", "I keep failing here", "done", "let me fix that", "perhaps a better approach would be another index", "all rows are read", "I was wrong and I overlooked a case",
)
TOOLS = ("Bash", "Read", "Edit", "Bash", "Grep", "mcp__docs__find", "Read", "Glob", "Skill")
COMMANDS = (
    "cd /srv/app && git status", "ls -la", "pytest -q tests || true", "docker exec db psql -c select", "export A=1; make build", "git push --force origin main", "echo start; rg needle src",
    "", "TOKEN=x curl -s localhost", "cd /tmp", "python run.py --no-verify", "session-search needle",
)
OUTPUTS = ("ok", "", "Error: No such file", "3 rows", "Permission denied", "needle found in src/app.py", "all tests passed", "FAILED test_one")
ERRORS = (
    "file not found: app.py", "PreToolUse:Bash hook denied", "connection refused on port 5432", "[retry-guard] BLOCK", "assertion failed in test_one", "ZENO RETRY-LOOP RULE applies", "syntax error near select *",
    "HOOK-BYPASS RULE " + "x" * 40, "absolute path expected",
)


def _pick(values: tuple[str, ...], place: str, sql: bool) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], CAST({place} AS INTEGER))" if sql else f"element_at(array({listed}), CAST({place} AS INTEGER))"


def _trace(sql: bool) -> dict[str, str]:
    """Columns of a session trace from events, in SQL that holds for either engine."""
    text = "VARCHAR" if sql else "STRING"
    k = "CAST(json_extract_string(props, '$.k') AS INTEGER)" if sql else "CAST(get_json_object(props, '$.k') AS INTEGER)"
    said, tool = "event_type IN ('purchase', 'signup')", _pick(TOOLS, f"(event_id + {k}) % {len(TOOLS)} + 1", sql)
    file = f"concat('/srv/app', CAST(event_id % 3 AS {text}), '/f', CAST({k} % 7 AS {text}), '.', {_pick(('py', 'md', 'sql', 'bin'), 'event_id % 4 + 1', sql)})"
    value = (
        f"CASE {tool} WHEN 'Bash' THEN concat('{{\"command\": \"', {_pick(COMMANDS, f'(event_id + user_id) % {len(COMMANDS)} + 1', sql)}, '\"}}') WHEN 'Grep' THEN '{{\"pattern\": \"needle\", \"path\": \"src\"}}' "
        f"WHEN 'Glob' THEN '{{\"pattern\": \"*.py\"}}' WHEN 'Skill' THEN '{{\"skill\": \"tidy-up\"}}' WHEN 'mcp__docs__find' THEN 'not json' ELSE concat('{{\"file_path\": \"', {file}, '\"}}') END"
    )
    return {
        "id": "event_id", "session_id": "user_id", "ts": "ts", "amount": "value", "k": k, "role": f"CASE WHEN {said} THEN 'user' ELSE 'assistant' END", "tool_name": f"CASE WHEN {said} THEN NULL ELSE {tool} END",
        "tool_input": f"CASE WHEN {said} THEN NULL ELSE {value} END",
        "output": f"CASE WHEN {said} OR event_id % 11 = 0 THEN NULL ELSE {_pick(OUTPUTS, f'(event_id + 3 * user_id) % {len(OUTPUTS)} + 1', sql)} END",
        "error": f"CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN {_pick(ERRORS, f'event_id % {len(ERRORS)} + 1', sql)} END",
        "content": f"CASE WHEN {said} THEN {_pick(SAY, f'(event_id * 5 + {k}) % {len(SAY)} + 1', sql)} END",
        "source_file": f"concat('/home/u/.claude/projects/', {_pick(('-home-user-dev-app', 'notes', '-srv-code-shop'), 'user_id % 3 + 1', sql)}, '/', CAST(user_id AS {text}), '.jsonl')",
    }


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a session trace: user messages, and tool calls with input, output and error."""
    return table(spark, sf_dir, "events").selectExpr(*TRACE_COLUMNS)


def _talk(sql: bool) -> str:
    said = f"CASE role WHEN 'user' THEN {_pick(SAY, f'(conv_id * 5 + turn) % {len(SAY)} + 1', sql)} WHEN 'assistant' THEN {_pick(REPLY, f'(conv_id + turn) % {len(REPLY)} + 1', sql)} ELSE text END"
    return f"CASE WHEN turn % 3 = 2 THEN concat({said}, '. ', text) ELSE {said} END"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages that hold phrases: session_id, idx, role, content."""
    return table(spark, sf_dir, "conversations").selectExpr(*TALK_COLUMNS)


TRACE_COLUMNS = [f"{e} AS {n}" for n, e in _trace(False).items()]
TALK_COLUMNS = ["conv_id AS session_id", "turn AS idx", "role", f"{_talk(False)} AS content"]
TRACE = "t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _trace(True).items()) + " FROM events)"
TALK = f"m AS (SELECT conv_id AS session_id, turn AS idx, role, {_talk(True)} AS content FROM conversations)"

LINES = (
    "# Rules for tools", "", "- NEVER use `SELECT *` in a query", "```", "you must always keep this out", "```", "* Always give **absolute paths** to tools", "1. You must not use git push --force here",
    "Some prose without an order", "<!-- must be kept -->", "- Do not edit generated files", "  - ALWAYS read the schema before a join", "- You must add type hints", "plain text about port numbers", "Must open port 5432 only from app.py",
    "- never assert in tests without a message",
)


def _rule_text(sql: bool) -> str:
    return "concat_ws(chr(10), " + ", ".join(_pick(LINES, f"(s_suppkey * {3 + i} + {i}) % {len(LINES)} + 1", sql) for i in range(8)) + ")"


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as rule files: path, text."""
    return table(spark, sf_dir, "supplier").selectExpr(f"concat('rules/', CAST(s_suppkey AS STRING), '.md') AS path", f"{_rule_text(False)} AS text")


RULE_FILES = f"f AS (SELECT 'rules/' || s_suppkey || '.md' AS path, {_rule_text(True)} AS text FROM supplier)"
