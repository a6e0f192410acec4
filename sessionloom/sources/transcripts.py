"""Transcript sources: JSONL session logs to normalised messages.

Lines are text; unreadable ones become null and go.  One row per content
block: user text, tool results (as assistant rows, named through the call
that they answer), assistant text and tool calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
MESSAGES = ("session_id", "file", "line", "block", "role", "content", "tool_name", "tool_input", "tool_output", "error", "ts", "tokens_in", "tokens_out", "model", "stop_reason", "is_sidechain")


def read_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, line, value); the line number is the rank of the line's place in its file."""
    d = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"))
    return d.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).drop("_at")


def _first(value: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(value, p) for p in paths])


def _blocks_text(raw: Column) -> Column:
    """Text blocks joined by newlines, or the string itself."""
    blocks = F.from_json(raw, BLOCK)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), joined).otherwise(raw)


def messages(lines: DataFrame) -> DataFrame:
    """lines(file, line, value) -> MESSAGES, in the order (file, line, block)."""
    v = F.col("value")
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    d = lines.where(F.coalesce(F.try_parse_json(v).isNotNull(), F.lit(False))).select(
        "file", "line", "value",
        F.coalesce(_first(v, "$.sessionId", "$.session_id"), stem).alias("session_id"),
        _first(v, "$.type").alias("type"), F.coalesce(_first(v, "$.message.role", "$.role"), F.lit("")).alias("role"),
        _first(v, "$.message.content", "$.content").alias("raw"), F.try_to_timestamp(_first(v, "$.timestamp")).alias("ts"),
        _first(v, "$.message.usage.input_tokens", "$.usage.input_tokens", "$.inputTokens", "$.input_tokens").cast("long").alias("tokens_in"),
        _first(v, "$.message.usage.output_tokens", "$.usage.output_tokens", "$.outputTokens", "$.output_tokens").cast("long").alias("tokens_out"),
        _first(v, "$.message.model", "$.model").alias("model"), _first(v, "$.message.stop_reason", "$.stop_reason", "$.stopReason").alias("stop_reason"),
        F.coalesce(_first(v, "$.isSidechain", "$.is_sidechain") == "true", F.lit(False)).alias("is_sidechain"),
    )
    meta = ["session_id", "file", "line", "ts", "tokens_in", "tokens_out", "model", "stop_reason", "is_sidechain"]
    none = F.lit(None).cast("string")
    flat = d.where("type is null and role <> ''").select(
        *meta, F.lit(0).alias("block"), F.when(F.col("role") == "human", "user").otherwise(F.col("role")).alias("role"), F.col("raw").alias("content"),
        *[_first(v, f"$.{n}").alias(n) for n in ("tool_name", "tool_input", "tool_output", "error")],
    )
    typed = d.where(F.col("type").isin("user", "assistant")).withColumn("_blocks", F.when(F.startswith(F.ltrim("raw"), F.lit("[")), F.from_json("raw", BLOCK)))
    each = typed.select(*meta, "type", F.posexplode("_blocks").alias("block", "b"))
    calls = each.where("b.type = 'tool_use'").select("session_id", F.col("b.id").alias("_id"), F.col("b.name").alias("_name")).dropDuplicates(["session_id", "_id"])
    use = each.where("type = 'assistant' and b.type = 'tool_use'").select(*meta, "block", F.lit("assistant").alias("role"), none.alias("content"), F.col("b.name").alias("tool_name"), F.col("b.input").alias("tool_input"), none.alias("tool_output"), none.alias("error"))
    said = typed.withColumn("content", _blocks_text(F.col("raw"))).where("content <> ''").select(*meta, F.lit(-1).alias("block"), F.col("type").alias("role"), "content", none.alias("tool_name"), none.alias("tool_input"), none.alias("tool_output"), none.alias("error"))
    result = each.where("type = 'user' and b.type = 'tool_result'").withColumn("_id", F.col("b.tool_use_id")).join(calls, ["session_id", "_id"], "left")
    out, bad = _blocks_text(F.col("b.content")), F.coalesce(F.col("b.is_error"), F.lit(False))
    result = result.select(*meta, "block", F.lit("assistant").alias("role"), none.alias("content"), F.col("_name").alias("tool_name"), none.alias("tool_input"), F.when(~bad, out).alias("tool_output"), F.when(bad, out).alias("error"))
    every = flat.select(*MESSAGES)
    for part in (use, said, result):
        every = every.unionByName(part.select(*MESSAGES))
    return every


def indexed(rows: DataFrame) -> DataFrame:
    """``idx`` by session: the order that every window over messages uses."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("session_id").orderBy("file", "line", "block")) - 1)


def without_sidechains(rows: DataFrame) -> DataFrame:
    """S25."""
    return rows.where(~F.coalesce("is_sidechain", F.lit(False)))


def tool_failures(rows: DataFrame) -> DataFrame:
    """Rows with an error text."""
    return rows.where(F.coalesce(F.length("error"), F.lit(0)) > 0)


def subagent_parent(path: Column) -> Column:
    """The session that a subagent's file belongs to, from either path shape; null for others."""
    a, b = F.regexp_extract(path, r"/([^/]+)/subagents/[^/]+\.jsonl$", 1), F.regexp_extract(path, r"/([^/]+)/agent-[^/]+\.jsonl$", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def split_handle(session: Column, agents: tuple[str, ...], default: str = "claude") -> tuple[Column, Column]:
    """Agent and native id of ``agent:native``; an id without a known agent is the default's."""
    head = F.substring_index(session, ":", 1)
    known = F.contains(session, F.lit(":")) & head.isin(*agents)
    return F.when(known, head).otherwise(default), F.when(known, F.substr(session, F.length(head) + 2)).otherwise(session)
