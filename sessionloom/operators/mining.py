"""From traces to error records: guards, tags, marks, approvals, session ends and facets.

A trace has id, session_id, ts, role, tool_name, tool_input, output, error, content and source_file; its rows are
ordered by (ts, id) within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.signals import by_time

#: Fixed value: what stands before the command that counts.
SCAFFOLD = r"^(cd\s+\S+|source\s+\S+|\.\s+\S+|set\s+[-+]\w+|export\s+\S+|[A-Z_][A-Z0-9_]*=\S+|echo\b.*|printf\b.*|sleep\s+\S+|true|:|test\b.*|\[.*)$"
ASSIGNMENT, SUBCOMMAND = r"^[A-Z_][A-Z0-9_]*=", r"^[a-zA-Z][\w-]*$"
PROJECT = r"/\.claude/projects/([^/]+)/"
#: What the names of project folders begin with and lose.
PREFIX = "-home-user-dev-"
NO = r"(?i)(?:^|\s)no[,.]?(?:\s|$)"


def holds(text: Column, patterns: tuple[str, ...]) -> Column:
    """Does one of the patterns occur?  Null texts: no."""
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def guard_noise(text: Column) -> Column:
    """A guard's own message, or a short text that shows a rule's header."""
    return holds(text, t.GUARDS) | (F.coalesce(F.length(text) < 4096, F.lit(False)) & holds(text, t.HEADERS))


def session_of_file(path: Column) -> Column:
    """The session that a file's name tells: what follows the first "Z-", or its stem."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.(md|jsonl)$", "")
    at = F.instr(stem, "Z-")
    return F.when(at > 0, F.substr(stem, at + 2)).otherwise(stem)


def project_tag(path: Column, prefix: str = PREFIX) -> Column:
    """The project's key from its folder's name."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), PROJECT, 1)
    short = F.when(F.startswith(name, F.lit(prefix)), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    return F.when(name == "", "unknown").when(short == "", name).otherwise(short)


def command_category(tool: Column, value: Column) -> Column:
    """Binary and subcommand of a shell call, past its scaffolding; the tool's name for others."""
    cmd = F.trim(F.coalesce(F.get_json_object(value, "$.command"), F.lit("")))
    parts = F.filter(F.transform(F.split(cmd, r"&&|\|\||;|\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(SCAFFOLD))
    words = F.transform(parts, lambda s: F.filter(F.split(s, r"\s+"), lambda w: ~w.rlike(ASSIGNMENT)))
    first = F.get(F.filter(words, lambda w: F.size(w) > 0), 0)
    binary, sub = F.substring_index(F.get(first, 0), "/", -1), F.get(first, 1)
    named = F.when(F.coalesce(sub.rlike(SUBCOMMAND), F.lit(False)), F.concat(binary, F.lit("-"), sub)).otherwise(binary)
    shell = (
        F.when(F.get_json_object(value, "$").isNull(), "bash-unparsed").when(cmd == "", "bash-empty")
        .when(F.contains(F.lower(cmd), F.lit("docker exec")) & F.contains(F.lower(cmd), F.lit("psql")), "docker-exec-psql").otherwise(F.coalesce(named, F.lit("bash-other")))
    )
    other = (F.coalesce(tool, F.lit("")) != "Bash") | (F.coalesce(value, F.lit("")) == "")
    return F.when(other, F.lower(F.when(F.coalesce(tool, F.lit("")) == "", "unknown").otherwise(tool))).otherwise(shell)


def tagged(rows: DataFrame) -> DataFrame:
    """+ project_tag, command_category, time_bucket."""
    return rows.select(
        "*", project_tag(F.col("source_file")).alias("project_tag"), command_category(F.col("tool_name"), F.col("tool_input")).alias("command_category"),
        F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown")).alias("time_bucket"),
    )


def error_records(trace: DataFrame) -> DataFrame:
    """Records of tool failures that are no guard's message, with their surroundings and tags."""
    w = by_time()
    user = F.last(F.when((F.col("role") == "user") & F.col("tool_name").isNull(), F.col("content")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = trace.select("*", user.alias("user_message"), F.lag("content").over(w).alias("context_before"), F.lead("content").over(w).alias("context_after"))
    d = d.where((F.coalesce("error", F.lit("")) != "") & ~guard_noise(F.col("error")))
    d = d.withColumn("session_id", F.coalesce(F.col("session_id").cast("string"), session_of_file(F.col("source_file")))).withColumn("error_type", F.lit("tool_failure"))
    return tagged(d.withColumnsRenamed({"error": "error_text", "output": "tool_output"}))


def stamped(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Every row with the same ordered list of the ids in force: one value, however many rows."""
    ids = rules.agg(F.array_join(F.array_sort(F.collect_set(F.col("rule_id").cast("string"))), ",").alias("rule_snapshot"))
    return rows.crossJoin(F.broadcast(ids))  # one row


def user_marks(trace: DataFrame) -> DataFrame:
    """User messages that begin like a correction, or shout."""
    c = F.lower(F.trim("content"))
    prefix = F.lit(False)
    for p in t.PREFIXES:
        prefix = prefix | F.startswith(c, F.lit(p))
    shout = F.contains("content", F.lit("!!")) | F.contains("content", F.lit("??"))
    return trace.where("role = 'user' and content is not null").select("*", prefix.alias("correction_prefix"), shout.alias("emphasis"))


def call_marks(trace: DataFrame) -> DataFrame:
    """Whether a call ran, was right and came out well; whether its command passes by a check."""
    failed = F.coalesce("error", F.lit("")) != ""
    return trace.where("tool_name is not null").select(
        "*", F.col("output").isNotNull().cast("int").alias("activated"), (~failed).cast("int").alias("correct_action"),
        (~failed & (F.coalesce("output", F.lit("")) != "")).cast("int").alias("correct_outcome"),
        F.coalesce(F.get_json_object("tool_input", "$.command").rlike(f"(?i){t.BYPASSES}"), F.lit(False)).alias("suppression"),
    )


def approvals_by_response(trace: DataFrame) -> DataFrame:
    """Each call with the next user message of its session; none or a blank one approves, a rejecting phrase rejects."""
    said = F.when((F.col("role") == "user") & F.col("tool_name").isNull(), F.coalesce("content", F.lit("")))
    answer = F.first(said, True).over(by_time().rowsBetween(1, Window.unboundedFollowing))
    no = t.any_of(F.col("answer"), t.REJECTION) | F.coalesce(F.col("answer").rlike(NO), F.lit(False))
    d = trace.withColumn("answer", answer).where("role = 'assistant' and tool_name is not null").withColumn("no", no)
    d = d.groupBy("tool_name").agg(F.count_if(~F.col("no")).alias("approved"), F.count_if("no").alias("rejected"))
    return d.withColumn("rate", F.round(F.col("approved") / (F.col("approved") + F.col("rejected")), 6))


def praised(text: Column) -> Column:
    """Any positive word or phrase."""
    return F.coalesce(text.rlike(f"(?i){t.PRAISE}"), F.lit(False)) | t.any_of(text, t.CONFIRMATION) | t.any_of(text, t.GRATITUDE)


def session_successes(trace: DataFrame) -> DataFrame:
    """Sessions whose last user message is positive, with no error since the positive one before."""
    n = F.row_number().over(by_time())
    user = (F.col("role") == "user") & F.col("tool_name").isNull()
    d = trace.select("session_id", n.alias("n"), "content", (F.coalesce("error", F.lit("")) != "").alias("bad"), user.alias("user"), (user & praised(F.col("content"))).alias("good"))
    last = F.max(F.when(F.col("user") & (F.trim("content") != ""), F.col("n"))).over(Window.partitionBy("session_id"))
    d = d.withColumn("last", last).where("n <= last").groupBy("session_id").agg(
        F.max(F.when(F.col("n") == F.col("last"), F.col("content"))).alias("signal_text"), F.bool_or((F.col("n") == F.col("last")) & F.col("good")).alias("good"),
        F.max(F.when((F.col("n") < F.col("last")) & F.col("bad"), F.col("n"))).alias("error_at"), F.max(F.when((F.col("n") < F.col("last")) & F.col("good"), F.col("n"))).alias("good_at"),
    )
    return d.where(F.col("good") & (F.col("error_at").isNull() | F.coalesce(F.col("good_at") > F.col("error_at"), F.lit(False)))).select("session_id", "signal_text")


def error_area(errors: DataFrame, kind: str) -> DataFrame:
    """The most frequent kind of error of a session; the one that came first among equals."""
    d = errors.groupBy("session_id", kind).agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("first"))
    best = F.min_by(F.struct(F.col(kind).alias("area"), "n"), F.struct((-F.col("n")).alias("m"), "first"))
    return d.groupBy("session_id").agg(best.alias("b")).select("session_id", "b.area", "b.n")


def facets(trace: DataFrame, mastery: DataFrame, area: DataFrame, mood: DataFrame, cache: DataFrame) -> DataFrame:
    """The facets of each session under a hash of its rows; sessions whose hash is in cache(session_id, key) are left out."""
    row = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "role", "tool_name", "content", "error"), 256)
    keys = trace.groupBy("session_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("key"))
    fresh = keys.join(cache, ["session_id", "key"], "left_anti")
    return fresh.join(mastery, "session_id", "left").join(area, "session_id", "left").join(mood, "session_id", "left")


def passive_signals(calls: DataFrame, seconds: int = 30, back: int = 4) -> DataFrame:
    """What the call that came next says of each: its message corrects, it does the same at once, or it tries another tool for the message of one of ``back`` calls.

    calls(id, session_id, ts, tool_name, message).
    """
    w = by_time()
    corrects = t.starts_with_any(F.lower(F.trim(F.coalesce("message", F.lit("")))), t.PREFIXES)
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts"))
    again = F.coalesce((F.lag("tool_name").over(w) == F.col("tool_name")) & (gap <= seconds * 1_000_000), F.lit(False))
    other = F.lit(False)
    for i in range(1, back + 1):
        other = other | F.coalesce((F.lag("message", i).over(w) == F.col("message")) & (F.lag("tool_name", i).over(w) != F.col("tool_name")), F.lit(False))
    d = calls.withColumn("_signal", F.when(corrects, "correction").when(again, "undo").when(other, "re_invocation"))
    return d.withColumn("passive_signal", F.lead("_signal").over(w)).drop("_signal")


def snapshots_of_sessions(trace: DataFrame, stored: DataFrame) -> DataFrame:
    """Calls, errors and positive messages so far of each session that stored(session_id) does not hold yet."""
    user = (F.col("role") == "user") & F.col("tool_name").isNull()
    d = trace.groupBy("session_id").agg(
        F.count_if(F.col("tool_name").isNotNull()).alias("tool_call_count"), F.count_if((F.coalesce("error", F.lit("")) != "") & ~guard_noise(F.col("error"))).alias("error_count"),
        F.count_if(user & praised(F.col("content"))).alias("positive_signal_count"),
    )
    return d.join(stored.select("session_id"), "session_id", "left_anti")
