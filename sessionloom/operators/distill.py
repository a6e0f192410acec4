"""Distilling a session's trace to the steps that led to its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.signals import by_time

READS, WRITES, EDITS = ("Read", "read_file"), ("Write", "write_file"), ("Edit", "edit_file")
LABELS = (("explore", "Phase 1: Exploration"), ("implement", "Phase 2: Implementation"), ("verify", "Phase 3: Verification"))


def failed() -> Column:
    """An error, or a short output with a word of failure."""
    out = F.coalesce(F.nullif("output", F.lit("")), F.col("content"), F.lit(""))
    return (F.coalesce("error", F.lit("")) != "") | ((F.length(out) < 500) & out.rlike(f"(?i){t.FAILED}"))


def undone() -> Column:
    """D3: one of the next five rows is a user's undo."""
    undo = (F.col("role") == "user") & F.lower(F.coalesce("content", F.lit(""))).rlike(t.TAKEN_BACK)
    return F.coalesce(F.max(undo).over(by_time().rowsBetween(1, 5)), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Share of equal characters place by place, of the longer text."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    return same / F.greatest(F.length(a), F.length(b))


def summary(tool: Column, value: Column) -> Column:
    """What a call did, in a line."""
    get = lambda *names: F.coalesce(*[F.get_json_object(value, f"$.{n}") for n in names], F.lit(""))
    short = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
    path, last = get("file_path", "path"), F.substring_index(tool, "__", -1)
    return (
        F.when(tool.isin(*READS), F.concat(F.lit("Read "), path)).when(tool.isin(*WRITES), F.concat(F.lit("Write "), path)).when(tool.isin(*EDITS), F.concat(F.lit("Edit "), path))
        .when(tool == "Bash", F.concat(F.lit("Run: "), short(get("command"), 120))).when(tool == "Grep", F.concat(F.lit("Search for '"), get("pattern"), F.lit("' in "), get("path")))
        .when(tool == "Glob", F.concat(F.lit("Find files: "), get("pattern"))).when(F.startswith(tool, F.lit("mcp__gemini")), F.concat(last, F.lit(": "), short(get("topic", "query"), 80)))
        .when(F.startswith(tool, F.lit("mcp__graphiti")), F.concat(F.lit("Graphiti "), last, F.lit(": "), short(get("query", "name"), 80)))
        .when(F.startswith(tool, F.lit("mcp__")), F.concat(F.lit("MCP: "), F.replace(F.replace(tool, F.lit("mcp__"), F.lit("")), F.lit("__"), F.lit(".")))).otherwise(tool)
    )


def judged(trace: DataFrame) -> DataFrame:
    """The calls that no undo took back, each failed, a retry of the call before, or kept."""
    calls = trace.select("*", undone().alias("_undone")).where("role = 'assistant' and tool_name is not null and not _undone").drop("_undone")
    a, b = F.coalesce("tool_input", F.lit("")), F.col("_input")
    like = (a != "") & (b != "") & (F.length(a) > 20) & (overlap(a, b) > 0.8)
    d = calls.select("*", F.lag("tool_name").over(by_time()).alias("_tool"), F.coalesce(F.lag(F.coalesce("tool_input", F.lit(""))).over(by_time()), F.lit("")).alias("_input"))
    retry = F.coalesce(F.col("_tool") == F.col("tool_name"), F.lit(False)) & ((a == b) | like)
    return d.withColumn("verdict", F.when(failed(), "failed").when(retry, "retry").otherwise("kept")).drop("_tool", "_input")


def steps(trace: DataFrame) -> DataFrame:
    """The winning path: kept calls without repeated reads of one file, numbered, with phases."""
    d = judged(trace).where("verdict = 'kept'").withColumn("summary", summary(F.col("tool_name"), F.col("tool_input")))
    again = F.coalesce(F.lag("summary").over(by_time()) == F.col("summary"), F.lit(False)) & F.col("tool_name").isin(*READS)
    d = d.withColumn("_again", again).where("not _again").drop("_again")
    num, total = F.row_number().over(by_time()), F.count("*").over(Window.partitionBy("session_id"))
    p = (F.col("step_num") - 1) / F.col("_total")
    d = d.select("*", num.alias("step_num"), total.alias("_total"))
    out = F.coalesce(F.nullif("output", F.lit("")), F.col("content"), F.lit(""))
    preview = F.when(F.length(out) > 200, F.concat(F.substring(out, 1, 197), F.lit("..."))).otherwise(out)
    return d.select("*", F.when(p < 0.3, "explore").when(p < 0.8, "implement").otherwise("verify").alias("phase"), preview.alias("preview")).drop("_total")


def hundredths(x: Column) -> Column:
    """x between 0 and 1 to two places by its exact binary value, half to even, as Python's round does; scaling the double first would move ties."""
    exact, one = (x * float(1 << 60)).cast("long").cast("decimal(20,0)") * F.lit(100), F.lit(1 << 60).cast("decimal(20,0)")
    rest = exact % one
    whole = ((exact - rest) / one).cast("long")
    half = F.lit(1 << 59).cast("decimal(20,0)")
    return F.when((rest > half) | ((rest == half) & (whole % 2 == 1)), whole + 1).otherwise(whole) / 100


def stats(trace: DataFrame) -> DataFrame:
    """One row per session: counts, the winning share, the goal and the outcome."""
    said = F.trim(F.when((F.col("role") == "user") & F.col("tool_name").isNull(), F.col("content")))
    at = F.struct("ts", "id")
    calls = F.count_if((F.col("role") == "assistant") & F.col("tool_name").isNotNull())
    whole = trace.groupBy("session_id").agg(
        F.count("*").alias("total_messages"), calls.alias("total_tool_calls"),
        F.coalesce(F.substring(F.min_by(said, F.when(F.length(said) > 10, at)), 1, 500), F.lit("")).alias("user_goal"),
        F.coalesce(F.substring(F.max_by(said, F.when(F.length(said) > 3, at)), 1, 300), F.lit("")).alias("final_outcome"),
    )
    fates = judged(trace).groupBy("session_id").agg(F.count_if(F.col("verdict") == "failed").alias("failed_calls"), F.count_if(F.col("verdict") == "retry").alias("retries"))
    won = steps(trace).groupBy("session_id").agg(F.count("*").alias("winning_steps"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    d = whole.join(fates, "session_id", "left").join(won, "session_id", "left").select("session_id", "total_messages", "total_tool_calls", "user_goal", "final_outcome", *map(zero, ("failed_calls", "retries", "winning_steps")))
    return d.withColumn("compression_ratio", hundredths(F.col("winning_steps") / F.greatest("total_tool_calls", F.lit(1))))


def playbooks(trace: DataFrame, title: str = "Session Playbook") -> DataFrame:
    """A session's steps as one markdown text."""
    first = F.coalesce(F.lag("phase").over(Window.partitionBy("session_id").orderBy("step_num")), F.lit("")) != F.col("phase")
    head = F.lit(None)
    for name, label in LABELS:
        head = F.when(F.col("phase") == name, f"## {label}\n\n").otherwise(head)
    cmd = F.get_json_object(F.substring("tool_input", 1, 500), "$.command")
    block = F.when((F.col("tool_name") == "Bash") & (F.length(cmd) > 0) & (F.length(cmd) < 200), F.concat(F.lit("   ```bash\n   "), cmd, F.lit("\n   ```\n"))).otherwise("")
    line = F.concat(F.when(F.col("first"), head).otherwise(""), F.col("step_num").cast("string"), F.lit(". **"), F.col("summary"), F.lit("**\n"), block)
    body = steps(trace).withColumn("first", first).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_num", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    goal = F.when(F.length("user_goal") > 200, F.concat(F.substring("user_goal", 1, 197), F.lit("..."))).otherwise(F.col("user_goal"))
    n = lambda c: F.col(c).cast("string")
    said = F.concat(
        F.lit("**Session Stats:** "), n("total_tool_calls"), F.lit(" tool calls → "), n("winning_steps"), F.lit(" winning steps ("), F.bround(F.col("compression_ratio") * 100, 0).cast("int").cast("string"),
        F.lit("% compression). Filtered out "), n("failed_calls"), F.lit(" failures, "), n("retries"), F.lit(" retries."),
    )
    text = F.concat(
        F.lit(f"# {title}\n\n"), F.when(F.col("user_goal") != "", F.concat(F.lit("**Goal:** "), goal, F.lit("\n\n"))).otherwise(""), said, F.lit("\n\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")),
        F.when(F.col("final_outcome") != "", F.concat(F.lit("## Outcome\n> "), "final_outcome", F.lit("\n"))).otherwise(""),
    )
    return stats(trace).join(body, "session_id", "left").select("session_id", F.rtrim(text).alias("playbook"))
