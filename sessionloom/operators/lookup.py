"""Finding sessions: files, time expressions, handles, filters, hits by category, transcripts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from dateutil import parser as dates
from dateutil.relativedelta import relativedelta
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: agents whose sessions are named "agent:id".
AGENTS = ("codex", "gemini", "goose", "aider", "opencode", "promptchain", "kimi")
DEFAULT_AGENT = "claude"
SEARCHES = r"\b(session-search|rg|ripgrep|grep|ag)\b"
CATEGORIES = ("discussed", "edited", "command", "output")
UNITS = (("days?|d", "days"), ("weeks?|w", "weeks"), ("months?|mo", "months"), ("hours?|h", "hours"), ("minutes?|mins?", "minutes"), ("years?|y", "years"))


def collected(spark: SparkSession, root: str, kinds: tuple[str, ...] = ("jsonl", "md")) -> DataFrame:
    """(path, length, modified) of every session file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(kinds)}}}").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def parse_since(expression: str, now: datetime) -> datetime:
    """The instant that "3 days", "2w", "yesterday", "last month", "2 days ago" or a date means, as of ``now``."""
    text = expression.strip().lower()
    for pattern, unit in UNITS:
        if m := re.fullmatch(rf"(\d+)\s*(?:{pattern})", text):
            return now - relativedelta(**{unit: int(m[1])})
    if text == "yesterday":
        return (now - timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)
    if text in ("last week", "last month", "last year"):
        return now - relativedelta(**{text[5:] + "s": 1})
    if m := re.fullmatch(r"(\d+\s+\w+)\s+ago", text):
        return parse_since(m[1], now)
    try:
        out = dates.parse(expression.strip(), fuzzy=True, default=now.replace(hour=0, minute=0, second=0, microsecond=0))
    except (ValueError, OverflowError) as e:
        raise ValueError(f"not a time expression: {expression!r}") from e
    return out if out.tzinfo else out.replace(tzinfo=timezone.utc)


def in_project(path: Column, name: str, ignore_case: bool = False) -> Column:
    """Does the path hold the project's name?"""
    return F.contains(F.lower(path), F.lit(name.lower())) if ignore_case else F.contains(path, F.lit(name))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def of_session(path: Column, native: str) -> Column:
    """Is the file named after the session?"""
    return stem(path) == native


def admitted(lines: DataFrame, messages: int = 5, calls: int = 2) -> DataFrame:
    """lines(path, line) -> files with their estimated messages and tool calls, and whether they are worth parsing."""
    x = F.trim("line")
    has = lambda *parts: F.coalesce(x.rlike("|".join(re.escape(p) for p in parts)), F.lit(False))
    jsonl = F.endswith("path", F.lit(".jsonl"))
    message = F.when(jsonl, x != "").otherwise((x == "---") | has("**Human:**", "**Assistant:**", "_**User**_", "_**Agent"))
    call = F.when(jsonl, has('"tool_use"', '"tool_name"')).otherwise(has("Tool call:", "Tool use:"))
    d = lines.groupBy("path").agg(F.count_if(message).alias("m"), F.count_if(call).alias("tool_calls"))
    # Separators stand between messages, so there is one message more than marks.
    d = d.select("path", F.when(~jsonl & (F.col("m") > 0), F.col("m") + 1).otherwise(F.col("m")).alias("messages"), "tool_calls")
    return d.withColumn("passes", (F.col("messages") >= messages) & (F.col("tool_calls") >= calls))


def offsets(files: DataFrame, state: DataFrame) -> DataFrame:
    """files(path, size, mtime) with state(path, offset, seen_mtime) -> where to read on; a file that shrank or went back in time begins anew."""
    d = files.join(state, "path", "left")
    anew = (F.col("size") < F.col("offset")) | F.coalesce(F.col("mtime") < F.col("seen_mtime") - 1, F.lit(False))
    start = F.when(F.col("offset").isNull() | anew, F.lit(0)).otherwise(F.col("offset"))
    return d.select("path", "size", start.alias("start"), F.coalesce(anew, F.lit(False)).alias("was_reset"), (start < F.col("size")).alias("has_new"))


def handle_of_path(path: Column) -> Column:
    """S27: "agent:id" by where a session's file lies."""
    agent = F.lit(DEFAULT_AGENT)
    for part, name in reversed((("/.codex/", "codex"), ("/goose/", "goose"), ("/opencode", "opencode"), ("/.gemini/", "gemini"), (".aider", "aider"), ("/.kimi-code/", "kimi"))):
        agent = F.when(F.contains(path, F.lit(part)), name).otherwise(agent)
    third = F.substring_index(F.substring_index(path, "/", -4), "/", 1)
    native = F.when((agent == "kimi") & F.endswith(path, F.lit("/wire.jsonl")) & (F.size(F.split(path, "/")) >= 5), third).otherwise(stem(path))
    return F.concat(agent, F.lit(":"), native)


def same_session(session: Column, handle: str) -> Column:
    """Rows of a session under its bare id or its full handle."""
    agent, _, native = handle.partition(":")
    if not native or agent not in (*AGENTS, DEFAULT_AGENT):
        agent, native = DEFAULT_AGENT, handle
    return session.isin(native, f"{agent}:{native}")


def resolved(rows: DataFrame, prefix: str) -> DataFrame:
    """The different session ids that begin with the prefix, bare or after an agent's name."""
    s = F.col("session_id")
    return rows.where(F.startswith(s, F.lit(prefix)) | F.contains(s, F.lit(":" + prefix))).select("session_id").distinct()


def backfilled(rows: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """Bare session ids get the agent's name; null and blank ones stay."""
    s = F.col("session_id")
    return rows.withColumn("session_id", F.when((F.coalesce(s, F.lit("")) != "") & ~F.contains(s, F.lit(":")), F.concat(F.lit(agent + ":"), s)).otherwise(s))


HOP1 = "id bigint, session_id string, ts timestamp, error_type string, tool_name string, error_text string"


def hop1_rows(rows: DataFrame) -> DataFrame:
    """Typed rows of a preview file; what it does not hold comes back blank."""
    return rows.select("*", *[F.lit("").alias(n) for n in ("context_before", "context_after", "tool_input")])


def read_hop1(spark: SparkSession, path: str) -> DataFrame:
    """The preview file itself (CSV with a header)."""
    return hop1_rows(spark.read.csv(path, schema=HOP1, header=True, escape='"', multiLine=True))


def recent(rows: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Q2: rows of the last ``days`` days; 0 means all."""
    return rows if days == 0 else rows.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def files_of(hits: DataFrame) -> DataFrame:
    """Q6: the different files of hits."""
    return hits.select("source_file").distinct()


def categorised(trace: DataFrame, pattern: str) -> DataFrame:
    """Q9, Q10: sessions that hold the pattern: strongest category, number of rows, latest instant, a snippet.

    Commands that search for it are no hit; a session of nothing else is left out.
    """
    m = lambda c: F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))
    get = lambda n: F.get_json_object("tool_input", f"$.{n}")
    path, cmd = F.coalesce(F.nullif(get("file_path"), F.lit("")), F.nullif(get("path"), F.lit("")), get("notebook_path")), get("command")
    rank = (
        F.when(m(F.col("content")), 0).when(m(path), 1).when(m(cmd) & ~cmd.rlike(SEARCHES), 2).when(m(F.col("output")), 3)
    )
    text = F.when(rank == 0, F.col("content")).when(rank == 1, path).when(rank == 2, cmd).when(rank == 3, F.col("output"))
    d = trace.select("session_id", "ts", "id", rank.alias("rank"), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 160).alias("snippet")).where("rank is not null")
    out = d.groupBy("session_id").agg(F.min("rank").alias("rank"), F.count("*").alias("hits"), F.max("ts").alias("latest"), F.min_by("snippet", F.struct("rank", "ts", "id")).alias("snippet"))
    return out.select("session_id", F.get(F.array(*map(F.lit, CATEGORIES)), F.col("rank")).alias("label"), "hits", "latest", "snippet")


def noise_hint(hits: DataFrame, most: int = 20) -> DataFrame:
    """Q11: how many hits there are, and a hint where they are too many."""
    n = F.count("*")
    return hits.agg(n.alias("n"), F.when(n > most, F.concat(n.cast("string"), F.lit(" hits: refine with a second set of terms"))).otherwise("").alias("hint"))


def expanded(trace: DataFrame) -> DataFrame:
    """Q12: the transcript of each session, a line for each row in order."""
    said = F.coalesce(F.nullif("content", F.lit("")), F.concat_ws(" ", "tool_name", "tool_input"))
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), said)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line")))), lambda x: x["line"])
    return trace.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("transcript"))


def inventory(records: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """Q13: for each known agent, whether there are records and how many, with the latest instant."""
    known = records.sparkSession.createDataFrame([(a,) for a in agents], "agent string")
    d = records.groupBy("agent").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return known.join(d, "agent", "left").select("agent", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"), "latest")


def fetched(
    errors: DataFrame, agent: str = "", session: str = "", kind: str = "", tool: str = "", since: str = "", project: str = "", limit: int = 0,
) -> DataFrame:
    """Q19: error records by any of the filters, newest first; the default agent's are those of no other."""
    d, s = errors, F.col("session_id")
    if agent == DEFAULT_AGENT:
        d = d.where(~s.rlike(f"^(?:{'|'.join(AGENTS)}):"))
    elif agent:
        d = d.where(F.startswith(s, F.lit(agent + ":")))
    if session:
        d = d.where(same_session(s, session))
    for column, value in (("error_type", kind), ("tool_name", tool)):
        if value:
            d = d.where(F.col(column) == value)
    if since:
        d = d.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if project:
        d = d.where(in_project(F.col("source_file"), project, True))
    d = d.orderBy(F.col("ts").desc(), F.col("id").desc())
    return d.limit(limit) if limit else d


def unlabelled(rows: DataFrame, labels: DataFrame, skill: str = "", session: str = "") -> DataFrame:
    """Q20: rows without a label, by skill or session where asked, with their place in the queue (oldest first)."""
    d = rows.join(labels.select("id"), "id", "left_anti")
    if skill:
        d = d.where(F.col("tool_name") == skill)
    if session:
        d = d.where(same_session(F.col("session_id").cast("string"), session))
    return d.select("*", F.row_number().over(Window.partitionBy("tool_name").orderBy("ts", "id")).alias("place"))
