"""Flows of traces, training examples and their files, and what is left of clusters and text kernels."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions import text as t
from sessionloom.operators import distill, flows
from sessionloom.operators.signals import by_time

# File endings that tell tools apart; surfaces of a rule; categories of errors with what tells them.
ENDINGS = "py js ts tsx jsx sql md yaml yml json toml sh css html txt csv parquet rs go java cpp ipynb".split()
SURFACES = ("agent_profile", "claude_md_rule", "hook_config", "mcp_config", "project_config", "settings_config", "skill_update")
CATEGORIES = (
    ("PermissionDenied", r"permission denied|not permitted|eacces"), ("CascadeFailure", r"sibling tool call|cancelled because"), ("ReadBeforeEdit", r"has not been read|read it first"),
    ("ContentTooLarge", r"too large|exceeds? max"), ("FileNotFound", r"not found|no such file"), ("NetworkTimeout", r"time[d ]*out|connection refused"), ("AuthError", r"unauthori[sz]ed|forbidden|invalid api key"),
    ("RateLimited", r"rate limit|too many requests"), ("WrongArgument", r"unexpected keyword|invalid argument|should be a valid|expected"), ("ToolApiError", r"api error|status: \d{3}"), ("GenericExit", r"exit code|assertion|syntax error"),
    ("StartupNoise", r"starting up|deprecat"),
)
FIELD, VALUE = r"(\w+)\s+Input should be a valid (\w+)", r"Input should be a valid (\w+).*?input_value=([^\]]+)"
TOKENS, SIZES = r"(\d+)\s*tokens?\)?\s*exceeds\s*maximum.*?(\d+)", r"(\d+(?:\.\d+)?(?:MB|KB|GB))\)\s*exceeds\s*maximum.*?(\d+(?:\.\d+)?(?:MB|KB|GB))"
# Each name with the patterns and groups to try in turn, and a pattern whose text tells nothing of it.
VARIABLES = (
    ("wrong_param", ((r"(\w+)\s+[Uu]nexpected keyword argument", 1), (r"[Uu]nexpected keyword argument.*?['\"]?(\w+)['\"]?", 1)), None), ("field_name", ((FIELD, 1),), None), ("expected_type", ((FIELD, 2), (VALUE, 1)), None), ("actual_value", ((VALUE, 2),), FIELD),
    ("actual_tokens", ((TOKENS, 1),), None), ("max_tokens", ((TOKENS, 2),), None), ("actual_size", ((SIZES, 1),), None), ("max_size", ((SIZES, 2),), None), ("http_status", ((r"Status:\s*(\d{3})", 1),), None),
    ("wrong_id", ((r"[Cc]loud [Ii][Dd]:\s*([a-f0-9-]{20,})", 1),), None), ("failed_target", ((r"Failed to fetch.*?for.*?:\s*(.+?)[\.\s]", 1),), None), ("function_name", ((r"for call\[(\w+)\]", 1),), None),
)
STRUGGLE = r"(?i)(Error|Exception|FAILED|exit code [1-9]|Permission denied|not found|No such file)"
FILE = r"[/\w.-]+\.\w{1,6}"


def differentiator(value: Column) -> Column:
    """what tells calls of one tool apart: a skill, a kind of helper, or a file's ending."""
    v = F.coalesce(value, F.lit(""))
    skill, helper = F.regexp_extract(v, r'"skill"\s*:\s*"([a-zA-Z0-9_:-]+)"', 1), F.regexp_extract(v, r'"subagent_type"\s*:\s*"([a-zA-Z0-9_:-]+)"', 1)
    ending = F.lower(F.regexp_extract(v, r"""["']([^"']+\.(\w{1,6}))["']""", 2))
    dot = lambda c: F.concat(F.lit("."), c)
    return F.when(skill != "", dot(skill)).when(helper != "", dot(helper)).when(ending.isin(*ENDINGS), dot(ending)).otherwise("")


def tool_stream(trace: DataFrame) -> DataFrame:
    """calls with their key; praised where the next user message is positive."""
    user = (F.col("role") == "user") & F.col("tool_name").isNull()
    good = F.coalesce((F.trim("content") != "") & F.col("content").rlike(f"(?i){t.PRAISE}"), F.lit(False))
    marked = F.coalesce(F.first(F.when(user, good), True).over(by_time().rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    d = trace.select("*", marked.alias("praised")).where("role = 'assistant' and tool_name is not null")
    return d.select("id", "session_id", "ts", "praised", F.concat("tool_name", differentiator(F.col("tool_input"))).alias("tool"))


def run_members(stream: DataFrame) -> DataFrame:
    """for each run of equal keys, the places in the session of the calls that it holds."""
    d = stream.select("*", (F.coalesce(F.lag("tool").over(by_time()), F.lit("")) != F.col("tool")).cast("int").alias("_new"), (F.row_number().over(by_time()) - 1).alias("place"))
    d = d.withColumn("run", F.sum("_new").over(by_time()))
    return d.groupBy("session_id", "run").agg(F.first("tool").alias("tool"), F.array_sort(F.collect_list("place")).alias("places"))


def flow_events(stream: DataFrame) -> DataFrame:
    """The flows of each session once, with success, the instant of the first call, and the session's span shared among its sequences."""
    grams = flows.ngrams(flows.runs(stream))
    span = stream.groupBy("session_id").agg((F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("span"))
    n = grams.groupBy("session_id").agg(F.count("*").alias("grams"))
    d = flows.first_per_session(grams).join(span.join(n, "session_id"), "session_id")
    return d.withColumn("duration", F.col("span") / F.col("grams")).drop("span", "grams")


def twin_pairs(events: DataFrame, least: int = 3, n: int = 3) -> DataFrame:
    """each flow that succeeds and fails often with n samples of either outcome, as nested rows."""
    samples = flows.paired_samples(events, n)
    row = F.struct(F.when(F.col("success") == 1, "success").otherwise("failure").alias("outcome"), "session_id", "ts")
    d = samples.groupBy("flow_hash", "sequence").agg(F.array_sort(F.collect_list(row)).alias("samples"))
    return flows.twins(events, least).join(d, "flow_hash")


def twin_positives(pairs: DataFrame) -> DataFrame:
    """one row for each successful sample, with the sessions of up to three failures beside it."""
    bad = F.slice(F.transform(F.filter("samples", lambda x: x["outcome"] == "failure"), lambda x: x["session_id"]), 1, 3)
    d = pairs.select("*", bad.alias("failure_sessions"), F.explode("samples").alias("s")).where("s.outcome = 'success'")
    return d.select("flow_hash", "sequence", F.col("s.session_id").alias("session_id"), F.col("s.ts").alias("ts"), "successes", "failures", "failure_sessions")


def flow_skills(events: DataFrame, examples: int = 10) -> DataFrame:
    """F16: flows seen twice or more with their rate, first examples, and a file name."""
    first = F.slice(F.array_sort(F.collect_list(F.struct("ts", F.col("session_id").cast("string").alias("s")))), 1, examples)
    d = events.groupBy("flow_hash", "sequence").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("rate"), first.alias("e")).where("n >= 2")
    names = F.transform(F.slice(F.split("sequence", flows.ARROW), 1, 4), lambda x: F.lower(F.replace(F.translate(F.trim(x), "()+ ", ""), F.lit("."), F.lit("_"))))
    return d.select("flow_hash", "sequence", "n", F.round("rate", 6).alias("rate"), F.array_join(F.transform("e", lambda x: x["s"]), ",").alias("examples"), F.concat(F.lit("flow-"), F.array_join(names, "-")).alias("slug"))


def flattened(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for readers that know no nesting."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema])


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nested columns stay nested."""
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    """Parquet with nested columns as text."""
    flattened(rows).write.mode("overwrite").parquet(path)


def collected(errors: DataFrame, since: str = "", kind: str = "", sessions: DataFrame | None = None) -> DataFrame:
    """Error records from an instant on, of a kind, of the given sessions(session_id)."""
    d = errors.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else errors
    d = d.where(F.col("error_type") == kind) if kind else d
    return d.join(sessions, "session_id", "left_semi") if sessions is not None else d


def examples(errors: DataFrame) -> DataFrame:
    """X11: an error record as a training example: inputs, empty outputs, and where it comes from."""
    text, blank = F.coalesce("error_text", F.lit("")), F.lit("")
    first = F.array(F.when(text == "", "No example available").otherwise(F.substring(text, 1, 500)))
    meta = F.struct(F.col("id").alias("error_record_id"), "tool_name", "ts", "session_id")
    data = F.struct(
        F.concat(F.lit("["), "error_type", F.lit("] "), F.substring(text, 1, 300)).alias("pattern_description"), first.alias("example_errors"), F.substring(F.coalesce("context_before", blank), 1, 500).alias("project_context"),
        blank.alias("rule_title"), blank.alias("rule_body"), blank.alias("rule_rationale"), meta.alias("_meta"),
    )
    return errors.select(F.array(*map(F.lit, ("pattern_description", "example_errors", "project_context"))).alias("inputs"), data.alias("data"))


def corpus(truth: DataFrame, most: int = 5) -> DataFrame:
    """Positive rows(error_type, pattern_summary, examples_json, label) -> description and up to five example texts from their JSON."""
    kind = "array<struct<error_text:string,error_message:string,context_message:string>>"
    got = F.transform(F.slice(F.coalesce(F.from_json("examples_json", kind), F.array().cast(kind)), 1, most), lambda x: F.coalesce(x["error_text"], x["error_message"], x["context_message"]))
    got = F.transform(F.filter(got, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.substring(x, 1, 500))
    s = F.coalesce("pattern_summary", F.lit(""))
    got = F.when(F.size(got) > 0, got).otherwise(F.array(F.when(s == "", "No example available").otherwise(s)))
    e = F.coalesce("error_type", F.lit(""))
    text = F.when((e != "") & (s != ""), F.concat(F.lit("["), e, F.lit("] "), s)).when(s != "", s).otherwise(e)
    return truth.where("label = 'positive'").select("id", text.alias("pattern_description"), got.alias("example_errors"))


def active_changes(changes: DataFrame) -> DataFrame:
    """Changes that nothing has superseded, with their place, the newest first, for each target."""
    w = Window.partitionBy("target").orderBy(F.col("applied_at").desc(), F.col("id").desc())
    return changes.where("superseded_at is null").select("*", F.row_number().over(w).alias("place"))


def exact_match(a: Column, b: Column) -> Column:
    """K7: equal, nulls being equal to each other."""
    return a.eqNullSafe(b)


def snapped(rows: DataFrame, raw: str, surfaces: tuple[str, ...] = SURFACES, default: str = "claude_md_rule") -> DataFrame:
    """K8: + surface: the known surface that the text names, or comes nearest to (a ratio of 0.6 at least), or the default.  Each different text is matched once."""
    clean = F.replace(F.replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))

    @F.pandas_udf("string")
    def nearest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x in surfaces else next(iter(difflib.get_close_matches(x, sorted(surfaces), n=1, cutoff=0.6)), default))

    d = rows.withColumn("_clean", clean)
    return d.join(d.select("_clean").distinct().select("_clean", nearest("_clean").alias("surface")), "_clean").drop("_clean")


def variables(samples: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """What the error texts of each key tell of parameters, values, sizes, codes and names; the last text that tells it counts.

    Quotes around values and blanks around targets go; null texts tell nothing.
    """

    def told(patterns: tuple, unless: str | None) -> Column:
        found = F.coalesce(*[F.nullif(F.trim(F.btrim(F.regexp_extract(text, p, g), F.lit("'\""))), F.lit("")) for p, g in patterns])
        return F.when(~F.col(text).rlike(unless), found) if unless else found

    d = samples.select("*", *[told(p, unless).alias(f"_{n}") for n, p, unless in VARIABLES])
    return d.groupBy(key).agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(n) for n, _, _ in VARIABLES])


def told_sql(text: str, patterns: tuple, unless: str | None) -> str:
    """One name's value in a text, in SQL."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    found = "coalesce(" + ", ".join(f"nullif(trim(trim(regexp_extract({text}, {quoted(p)}, {g}), {quoted(chr(39) + chr(34))})), '')" for p, g in patterns) + ")"
    return f"CASE WHEN NOT regexp_matches({text}, {quoted(unless)}) THEN {found} END" if unless else found


def dominant_term(members: DataFrame, cluster: str) -> DataFrame:
    """The name of each cluster: its most frequent kind; else the most frequent first word; else "error"."""
    word = F.nullif(F.substring(F.regexp_extract(F.lower(F.coalesce("error_text", F.lit(""))), "^[a-z][a-z0-9_]*", 0), 1, 20), F.lit(""))
    d = members.select(cluster, F.nullif("error_type", F.lit("")).alias("kind"), word.alias("word"))
    d = d.groupBy(cluster, "kind", "word").agg(F.count("*").alias("n"))
    best = lambda c: d.where(F.col(c).isNotNull()).groupBy(cluster, c).agg(F.sum("n").alias("n")).groupBy(cluster).agg(F.min_by(c, F.struct((-F.col("n")).alias("m"), c)).alias(c))
    clean = F.nullif(F.btrim(F.substring(F.regexp_replace(F.lower("kind"), "[^a-z0-9_]+", "_"), 1, 30), F.lit("_")), F.lit(""))
    return members.select(cluster).distinct().join(best("kind"), cluster, "left").join(best("word"), cluster, "left").select(cluster, F.coalesce(clean, "word", F.lit("error")).alias("term"))


def reused_vectors(rows: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The cached vector of a description that the cache holds once for this model; null where it must be computed."""
    once = cache.where(F.col("model") == model).groupBy("description").agg(F.count("*").alias("n"), F.any_value("vector").alias("vector")).where("n = 1").select("description", "vector")
    return rows.join(once, "description", "left")


def token_overlap(a: Column, b: Column) -> Column:
    """C14: shared words over the words of the larger set; 0 where either has none."""
    x, y = F.array_distinct(t.tokens(a)), F.array_distinct(t.tokens(b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(x), F.size(y))), F.lit(0.0))


def category(text: Column) -> Column:
    """The first of twelve categories whose words the error text holds, or "Other": rules in place of a language model."""
    out = F.lit("Other")
    for name, pattern in reversed(CATEGORIES):
        out = F.when(F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False)), name).otherwise(out)
    return out


def category_slug(kind: Column, tool: Column, name: Column, cycle: str) -> Column:
    """The key of a kind and category within a cycle; repeated attempts are keyed by their tool."""
    k = F.lower(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")))
    return F.when(k == "repeated_attempt", F.concat(F.lit("repeated_attempt__"), F.lower(F.coalesce(tool, F.lit("unknown"))))).otherwise(F.concat(k, F.lit("__"), F.lower(name), F.lit(f"__{cycle}")))


def word_vector(text: Column) -> Column:
    """Counts of words by the first hex digit of their md5: sixteen numbers, in place of a model that is not at hand."""
    digits = F.transform(t.tokens(text), lambda w: F.substring(F.md5(w), 1, 1))
    # As the one item of an array, so that words are hashed once and not for each of the numbers.
    return F.transform(F.array(digits), lambda all_: F.transform(F.array(*map(F.lit, "0123456789abcdef")), lambda d: F.size(F.filter(all_, lambda x: x == d)).cast("double")))[0]


def embedded(rows: DataFrame, text: str, cache: DataFrame, provider: Callable[[Column], Column] = word_vector) -> DataFrame:
    """+ key, vector, cached: from cache(key, vector) by the text's sha256; each other text is computed."""
    d = rows.withColumn("key", F.sha2(F.coalesce(text, F.lit("")), 256)).join(cache.withColumnRenamed("vector", "_old"), "key", "left")
    return d.withColumn("cached", F.col("_old").isNotNull()).withColumn("vector", F.when(F.col("cached"), F.col("_old")).otherwise(provider(F.col(text)))).drop("_old")


def struggles(steps: DataFrame) -> DataFrame:
    """steps(session_id, step_num, tool, summary, preview): each that failed, with the first of the next three of its tool or a file of its that went well."""
    bad = F.concat_ws(" ", "preview", "summary").rlike(STRUGGLE)
    files = F.regexp_extract_all("summary", F.lit(f"({FILE})"), 1)
    row = F.struct("step_num", "tool", "summary", files.alias("files"), F.coalesce(F.col("preview"), F.lit("")).rlike(STRUGGLE).alias("bad"))
    ahead = F.collect_list(row).over(Window.partitionBy("session_id").orderBy("step_num").rowsBetween(1, 3))
    d = steps.select("session_id", "step_num", "tool", files.alias("files"), bad.alias("bad"), ahead.alias("ahead")).where("bad")
    fits = F.filter("ahead", lambda x: ((x["tool"] == F.col("tool")) | F.arrays_overlap(x["files"], F.col("files"))) & ~x["bad"])
    return d.select("session_id", F.col("step_num").alias("failure_step"), F.get(fits, 0)["step_num"].alias("fix_step")).where("fix_step is not null")


def all_steps(trace: DataFrame) -> DataFrame:
    """Every call as a step, for struggles()."""
    d = trace.where("role = 'assistant' and tool_name is not null").select("*", F.row_number().over(by_time()).alias("step_num"))
    return d.select("session_id", "step_num", F.col("tool_name").alias("tool"), distill.summary(F.col("tool_name"), F.col("tool_input")).alias("summary"), F.col("output").alias("preview"))


def session_usage(calls: DataFrame) -> DataFrame:
    """Tokens, cache share, cost, stop reasons and the most frequent model of each session: calls(session_id, model, stop_reason, tokens_in, tokens_out, cache_read, cost)."""
    each = calls.groupBy("session_id", "model", "stop_reason").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cost")])
    by_reason = each.groupBy("session_id", "stop_reason").agg(F.sum("n").alias("n")).where("stop_reason is not null")
    reasons = by_reason.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("stop_reason", F.lit("="), F.col("n").cast("string")))), ",").alias("stop_reasons"))
    models = each.groupBy("session_id", "model").agg(F.sum("n").alias("n")).groupBy("session_id").agg(F.min_by("model", F.struct((-F.col("n")).alias("m"), "model")).alias("model"))
    sums = each.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_read")], F.round(F.sum("cost"), 4).alias("cost"))
    share = F.round(F.coalesce(F.try_divide(F.col("cache_read").cast("double"), F.col("cache_read") + F.col("tokens_in")), F.lit(0.0)), 6)
    return sums.withColumn("cache_ratio", share).join(reasons, "session_id", "left").join(models, "session_id", "left")


def lifecycle(errors: DataFrame, least: int = 5, hot: int = 3, recent: int = 3, after: int = 15) -> DataFrame:
    """signatures(project, command, kind) seen often: still active, fixed while the project went on, dormant with it, or minor."""
    sig = ["project_tag", "command_category", "error_type"]
    later = F.count("*").over(Window.partitionBy("project_tag").orderBy(F.col("ts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.count("*").over(Window.partitionBy("project_tag", "ts"))
    d = errors.select(*sig, "ts", F.to_date("ts").alias("day"), (later - same).alias("later"))
    days = d.groupBy(*sig, "day").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("later", "ts").alias("later"))
    x = days.groupBy(*sig).agg(F.sum("n").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("peak"), F.max_by("later", "last").alias("after"))
    newest = errors.agg(F.max("ts").alias("_newest"))  # one row
    x = x.where(F.col("total") >= least).crossJoin(F.broadcast(newest)).withColumn("idle", F.timestamp_diff("DAY", "last", "_newest")).drop("_newest")
    life = F.when(F.col("idle") <= recent, "ACTIVE").when((F.col("peak") >= hot) & (F.col("after") >= after), "FIXED").when(F.col("peak") >= hot, "DORMANT").otherwise("MINOR")
    return x.withColumn("life", life)
