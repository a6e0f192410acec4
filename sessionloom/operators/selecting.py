"""Choosing and summing up records: curation, promotion, clusters, flows, health, frictions and built datasets.

Error records have id, session_id, ts, tool_name, tool_input, error_text, user_message, error_type, pattern_id and
source_file; positive records have id, ts, source_file, kind and sentiment.  Null files and instants meet nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators.signals import by_time, positive_kind

# Kinds of positive records that promote, and the modes of failure with what shows each.
PROMOTING = ("confirmation", "session_success", "implicit_approval")
MODES = {"incorrect_outcome": "not correct_outcome", "not_activated": "not activated", "wrong_action": "not correct_action"}
MICROS = 1_000_000


@dataclass(frozen=True)
class Filters:
    """What a curated record has to fulfil; a field left as it is narrows nothing, but for corrections and cascades."""

    since: str | None = None  # an instant; earlier records go
    emphasis: bool = False  # the message holds !! or ??
    classified: bool = False  # the pattern is known
    pattern: str | None = None
    pattern_prefix: str | None = None  # in either case
    error_types: tuple[str, ...] = ()
    exclude_corrections: bool = True
    exclude_cascade: bool = True
    recovered_within: int | None = None  # a positive record of the same file follows within so many seconds

    def condition(self) -> Column:
        """All but the last, as one condition that reaches the scan; null counts as not fulfilled, a null pattern as no cascade."""
        message, pattern, kind = F.col("user_message"), F.col("pattern_id"), F.col("error_type")
        asked = [
            (self.since is not None, F.col("ts") >= F.to_timestamp_ntz(F.lit(self.since))),
            (self.emphasis, F.contains(message, F.lit("!!")) | F.contains(message, F.lit("??"))),
            (self.classified, pattern.isNotNull() & (pattern != "")),
            (self.pattern is not None, pattern == self.pattern),
            (self.pattern_prefix is not None, F.startswith(F.lower(pattern), F.lower(F.lit(self.pattern_prefix)))),
            (bool(self.error_types), kind.isin(*self.error_types)),
            (self.exclude_corrections, kind != "user_correction"),
            (self.exclude_cascade, pattern.isNull() | ~F.contains(F.lower(pattern), F.lit("cascade"))),
        ]
        out = F.lit(True)
        for wanted, holds in asked:
            out = out & holds if wanted else out
        return out


def _micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def recovered(errors: DataFrame, positives: DataFrame, seconds: int) -> DataFrame:
    """Errors after which, in under ``seconds``, a positive record of their file follows.

    Time is cut into steps of that length.  In an error's own step the latest
    positive decides, in the next one the earliest, so a step of a file is one
    row of the join, however many positives it holds.
    """
    width = seconds * MICROS
    p = positives.select(F.col("source_file").alias("_file"), _micros().alias("_p")).where("_file is not null and _p is not null")
    ends = p.groupBy("_file", F.floor(F.col("_p") / width).alias("_step")).agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"))
    near = ends.select("_file", "_step", "hi", F.lit(None).cast("long").alias("lo")).unionByName(ends.select("_file", (F.col("_step") - 1).alias("_step"), F.lit(None).cast("long").alias("hi"), "lo"))
    near = near.groupBy("_file", "_step").agg(F.max("hi").alias("_hi"), F.max("lo").alias("_lo"))
    e = errors.withColumn("_t", _micros())
    hit = (F.col("source_file") == F.col("_file")) & (F.floor(F.col("_t") / width) == F.col("_step")) & ((F.col("_hi") > F.col("_t")) | (F.col("_lo") - F.col("_t") < width))
    return e.join(near, hit, "left_semi").drop("_t")


def curated(errors: DataFrame, filters: Filters, positives: DataFrame | None = None) -> DataFrame:
    """The records that all filters keep, with all their columns; the order and a limit are the caller's."""
    kept = errors.where(filters.condition())
    if filters.recovered_within is None:
        return kept
    if positives is None:
        raise ValueError("recovered_within needs the positive records")
    return recovered(kept, positives, filters.recovered_within)


def positive_records(trace: DataFrame) -> DataFrame:
    """E13 over a trace: user messages that confirm, thank or, after a tool was used, approve; with that tool and what the assistant said last."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    said = F.last(F.when((F.col("role") == "assistant") & F.col("content").isNotNull(), F.substring("content", 1, 200)), True).over(before)
    d = trace.select("*", F.last("tool_name", True).over(before).alias("prior_tool"), said.alias("context_before")).where("role in ('user', 'human') and tool_name is null and trim(content) <> ''")
    d = d.withColumn("kind", positive_kind(F.col("content"), F.col("prior_tool").isNotNull())).where("kind is not null")
    return d.select("id", "session_id", "ts", "source_file", "kind", F.col("content").alias("signal_text"), "context_before", "prior_tool")


def promotions(positives: DataFrame, errors: DataFrame, truths: DataFrame, least: float, since: str | None = None, seconds: int = 600) -> DataFrame:
    """(positive_id, error_id, pattern_id, kind): each error of a positive record's file in the ``seconds`` before it.

    Positive records count from ``since`` on, of a kind that promotes, with a
    sentiment of ``least`` or more (null: 1).  A pattern that already waits in
    truths(pattern_id, label, source) as pending from a positive record is left
    out; a null pattern never waits.  Steps of time are keys of the join.
    """
    width = seconds * MICROS
    p = positives.where(F.col("kind").isin(*PROMOTING) & (F.coalesce("sentiment", F.lit(1.0)) >= least))
    if since is not None:
        p = p.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(since)))
    p = p.select(F.col("id").alias("positive_id"), "kind", "source_file", _micros().alias("_p")).withColumn("_step", F.floor(F.col("_p") / width))
    waiting = truths.where("label = 'pending' and source = 'positive_record' and pattern_id is not null").select("pattern_id").distinct()
    e = errors.select(F.col("id").alias("error_id"), "pattern_id", "source_file", _micros().alias("_t")).join(waiting, "pattern_id", "left_anti")
    step = F.floor(F.col("_t") / width)
    e = e.withColumn("_step", F.explode(F.array(step, step + 1)))
    near = (F.col("_t") < F.col("_p")) & (F.col("_p") - F.col("_t") < width)
    return p.join(e, ["source_file", "_step"]).where(near).select("positive_id", "error_id", "pattern_id", "kind")


def cluster_rows(members: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Each cluster's first text, most frequent tool and kind, counts and span.

    First is the row of least (ts, id), null instants first; among equally
    frequent tools or kinds the one that came first counts.  A null tool is a
    value, null and empty kinds are none; without any, the kind is "error".
    Members keep their own rows: ``members`` is the list of them.
    """
    place = F.struct(F.col("ts").isNotNull().alias("known"), "ts", "id")
    d = members.groupBy(key, "tool_name", "error_type", "session_id").agg(
        F.count("*").alias("n"), F.min(place).alias("at"), F.min_by("error_text", place).alias("text"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )

    def modal(column: str) -> DataFrame:
        each = d.groupBy(key, column).agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        each = each.where(F.coalesce(column, F.lit("")) != "") if column == "error_type" else each
        return each.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(column), F.struct((-F.col("n")).alias("n"), "at")).alias(f"_{column}"))

    out = d.groupBy(key).agg(
        F.min_by("text", "at").alias("description"), F.sum("n").alias("error_count"), F.count_distinct("session_id").alias("session_count"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen")
    )
    for column in ("tool_name", "error_type"):
        out = out.join(modal(column), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    kind = F.coalesce("_error_type.error_type", F.lit("error"))
    return out.select(key, "description", F.col("_tool_name.tool_name").alias("tool_name"), kind.alias("error_type"), "error_count", "session_count", "first_seen", "last_seen")


def flow_table(events: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """the ``top`` flows by count times success rate, that is by successes (ties: more rows, then the hash), with mean duration and rank."""
    d = events.groupBy("flow_hash").agg(
        F.min("sequence").alias("sequence"), F.min("size").alias("size"), F.count("*").alias("total"), F.sum("success").cast("long").alias("successes"), F.avg("duration").alias("d"),
        F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("last_seen"),
    )
    d = d.where(F.col("total") >= least).orderBy(F.col("successes").desc(), F.col("total").desc(), "flow_hash").limit(top)
    rank = F.row_number().over(Window.orderBy(F.col("successes").desc(), F.col("total").desc(), "flow_hash"))  # over ``top`` rows
    rate = F.round(100.0 * F.col("successes") / F.col("total"), 1)
    return d.select(rank.alias("rank"), "flow_hash", "sequence", "size", "total", "successes", rate.alias("success_rate"), F.round("d", 1).alias("avg_duration"), "sessions", "last_seen")


def health_by_platform(calls: DataFrame) -> DataFrame:
    """calls(actual_action, platform, activated, correct_action, user_satisfied) by action and platform.

    A false trigger was activated and is no correct action, a missed one was not
    activated; nulls are neither.  The rate is over labelled calls, null without any.
    """
    d = calls.groupBy("actual_action", "platform").agg(
        F.count("*").alias("total"), F.count_if("user_satisfied").alias("satisfied"), F.count_if(~F.col("user_satisfied")).alias("unsatisfied"), F.count_if(F.col("user_satisfied").isNull()).alias("unlabelled"),
        F.count_if(F.col("activated") & ~F.col("correct_action")).alias("false_triggers"), F.count_if(~F.col("activated")).alias("missed_triggers"),
    )
    return d.withColumn("rate", F.round(F.try_divide(F.col("satisfied").cast("double"), F.col("satisfied") + F.col("unsatisfied")), 6))


def failure_modes(calls: DataFrame) -> DataFrame:
    """H4: (behavior_type, mode, n) for the three named modes, 0 included; a call may show several."""
    d = calls.groupBy("behavior_type").agg(*[F.count_if(F.expr(c)).alias(m) for m, c in MODES.items()])
    return d.unpivot("behavior_type", list(MODES), "mode", "n")


def frictions(errors: DataFrame, least: int = 4, cap_min: int = 12, repeat_min: int = 15) -> DataFrame:
    """Active minutes, rapid repeats and passed-by checks of each signature (project, command, kind).

    A gap between neighbours in time counts as active up to ``cap_min`` minutes
    and as a rapid repeat up to ``repeat_min``; equal and null instants leave no
    gap.  Gaps are taken within a day, and between days from the last of one to
    the first of the next, so that a hot signature is split by its days; gaps
    must therefore be under a day.  A quarter passed by: BYPASS; else half
    rapid: TRIAL-AND-ERROR; else FRICTION.
    """
    if not 0 < max(cap_min, repeat_min) < 1440:
        raise ValueError("gaps are counted in minutes of less than a day")
    signature = ["project_tag", "command_category", "error_type"]
    active = lambda g: F.when((g > 0) & (g <= cap_min * 60 * MICROS), g).otherwise(F.lit(0))
    rapid = lambda g: ((g > 0) & (g <= repeat_min * 60 * MICROS)).cast("long")
    bypass = F.coalesce(F.col("tool_input").rlike(f"(?i){t.BYPASSES}"), F.lit(False))
    d = errors.select(*signature, _micros().alias("at"), bypass.alias("bypass")).withColumn("day", F.floor(F.col("at") / (86_400 * MICROS)))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(*signature, "day").orderBy("at"))
    d = d.withColumn("gap", gap).groupBy(*signature, "day").agg(
        F.count("*").alias("n"), F.count_if("bypass").alias("bypassed"), F.sum(active(F.col("gap"))).alias("active"), F.sum(F.coalesce(rapid(F.col("gap")), F.lit(0))).alias("rapid"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    edge = F.col("lo") - F.lag("hi").over(Window.partitionBy(*signature).orderBy("day"))
    d = d.withColumn("edge", edge).groupBy(*signature).agg(
        F.sum("n").alias("cycles"), F.sum("bypassed").alias("bypassed"), F.sum(F.col("active") + F.coalesce(active(F.col("edge")), F.lit(0))).alias("active"), F.sum(F.col("rapid") + F.coalesce(rapid(F.col("edge")), F.lit(0))).alias("rapid")
    )
    share = lambda n, of: F.bround(100 * F.col(n) / of, 0).cast("long")
    d = d.where(F.col("cycles") >= least).select(
        *signature, "cycles", F.round(F.col("active") / (60.0 * MICROS), 1).alias("active_min"), share("rapid", F.greatest(F.col("cycles") - 1, F.lit(1))).alias("rapid_pct"), share("bypassed", F.col("cycles")).alias("suppression_pct")
    )
    return d.withColumn("resolution", F.when(F.col("suppression_pct") >= 25, "BYPASS").when(F.col("rapid_pct") >= 50, "TRIAL-AND-ERROR").otherwise("FRICTION"))


def examples(bridge: DataFrame, errors: DataFrame, existing: DataFrame | None = None, least: int = 5) -> DataFrame:
    """bridge(pattern_id, error_id) with its error records as examples, label 1 where the error text is empty or null.

    Rows of existing(pattern_id, id, label, error_text) stay, and new ones join
    them by (pattern, id); None builds anew.  Patterns of fewer than ``least``
    examples in all go.  Repeated rows of the bridge are one, ids without a
    record none.
    """
    e = errors.select(F.col("id"), F.coalesce("error_text", F.lit("")).alias("error_text"))
    made = bridge.select("pattern_id", F.col("error_id").alias("id")).distinct().join(e, "id").select("pattern_id", "id", (F.col("error_text") == "").cast("int").alias("label"), "error_text", F.lit(True).alias("fresh"))
    if existing is not None:
        old = existing.select("pattern_id", "id", "label", "error_text", F.lit(False).alias("fresh"))
        made = old.unionByName(made.join(old.select("pattern_id", "id"), ["pattern_id", "id"], "left_anti"))
    enough = made.groupBy("pattern_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pattern_id")
    return made.join(enough, "pattern_id", "left_semi")


def example_counts(made: DataFrame) -> DataFrame:
    """What a built dataset says of itself."""
    return made.groupBy("pattern_id").agg(F.count_if(F.col("label") == 1).alias("positive_count"), F.count_if(F.col("label") == 0).alias("negative_count"), F.count_if("fresh").alias("fresh"))


HOUR = 3600 * MICROS
# Fixed value: words that a topic's words stand for besides themselves, as patterns.
TOPICS = {
    "dbt": ("dbt", r"profiles\.yml", "dbt_project", "models/", "target/", "seeds/"), "cube": ("cube", "cubejs", r"cube\.js", "schema/", r"\.yml"), "snowflake": ("snowflake", "snowsql"),
    "superset": ("superset", "dataset", "chart"), "tableau": ("tableau", "twb", "tds", "workbook"), "prefect": ("prefect", "flow", "deployment", "work.pool"),
}
# Fixed value: where a rule against a kind of error goes.
SURFACES = {"tool_failure": "claude_md_rule", "user_correction": "claude_md_rule", "agent_admission": "claude_md_rule", "repeated_attempt": "hook_config", "undo": "settings_config"}


def topic_pattern(query: str) -> str:
    """A pattern for any word of over two characters of a query, taken literally, or what it stands for; any text without such words."""
    words = [w.lower() for w in query.split() if len(w) > 2]
    parts = [p for w in words for p in (re.sub(r"([^\w\s])", r"\\\1", w, flags=re.ASCII), *TOPICS.get(w, ()))]
    return f"(?i){'|'.join(parts)}" if parts else "(?s).*"


def rule_reports(errors: DataFrame, days: int = 7) -> DataFrame:
    """errors(ts, error_type, rules array) -> for each rule and kind of error, and for all kinds (null), how many came
    in the ``days`` before the rule was first seen and from then on, with the rule's file as target and the rules seen beside it.

    The first instant belongs to what comes after, as does the last one.  Whole
    hours come from counts by hour; only rows of a window's three edge hours meet
    the rule itself.  A null kind is the empty one; null instants and rules count
    for nothing.  Beside it are rules of the same row in the window after.
    """
    e = errors.select(_micros().alias("at"), F.coalesce("error_type", F.lit("")).alias("error_type"), "rules").where("at is not null").withColumn("hour", F.floor(F.col("at") / HOUR))
    sets = e.where("rules is not null").groupBy(F.array_sort(F.array_distinct(F.array_compact("rules"))).alias("rules")).agg(F.min("at").alias("at"))
    each = sets.select("rules", "at", F.explode("rules").alias("rule_id"))
    span = days * 24 * HOUR
    seen = each.groupBy("rule_id").agg(F.min("at").alias("t0")).withColumns({"lo": F.col("t0") - span, "hi": F.col("t0") + span})
    beside = each.join(seen.select("rule_id", "hi"), "rule_id").where("at <= hi").select("rule_id", F.explode("rules").alias("other")).where("other <> rule_id")
    beside = beside.groupBy("rule_id").agg(F.array_sort(F.collect_set("other")).alias("related"))

    hour = lambda c: F.floor(F.col(c) / HOUR)
    hours = seen.withColumn("hour", F.explode(F.sequence(hour("lo"), hour("hi")))).withColumn("edge", F.col("hour").isin(hour("lo"), hour("t0"), hour("hi")))
    whole = hours.where("not edge").join(e.groupBy("hour", "error_type").agg(F.count("*").alias("n")), "hour").select("rule_id", "error_type", (F.col("hour") < hour("t0")).alias("early"), "n")
    near = hours.where("edge").join(e, "hour").where("at >= lo and at <= hi").select("rule_id", "error_type", (F.col("at") < F.col("t0")).alias("early"), F.lit(1).cast("long").alias("n"))
    count = lambda early: F.coalesce(F.sum(F.when(F.col("early") == early, F.col("n"))), F.lit(0))
    d = whole.unionByName(near).rollup("rule_id", "error_type").agg(count(True).alias("before"), count(False).alias("after")).where("rule_id is not null")
    delta = 100.0 * F.try_divide(F.col("after") - F.col("before"), F.col("before"))
    d = d.withColumn("delta_pct", F.round(delta, 4)).join(beside, "rule_id", "left")
    n = F.col("after")
    tier = F.when(n >= 100, "high").when(n >= 25, "medium").otherwise("low")
    advice = F.when((n < 25) | F.col("delta_pct").isNull(), "more data").when(delta <= -20, "keep").when(delta >= 10, "review").otherwise("watch")
    first = F.timestamp_micros("t0").cast("timestamp_ntz")
    d = d.join(seen.select("rule_id", first.alias("first_seen")), "rule_id")
    return d.select("rule_id", F.substring_index("rule_id", "#", 1).alias("target_surface"), "first_seen", "error_type", "before", "after", "delta_pct", tier.alias("tier"), advice.alias("advice"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def pattern_summaries(rows: DataFrame, key: str = "pattern_id", top: int = 5) -> DataFrame:
    """For each pattern the span, its ``top`` tools, ``top`` messages and the surface that its most frequent kind goes to.

    Messages are cut to 200 characters; of those whose first 80 are equal but for
    case the first counts, in the order of (ts, id), null instants first.  Blank
    messages and null tools are none; equally frequent tools and kinds in order of name.
    """
    place = F.struct(F.col("ts").isNotNull().alias("known"), "ts", "id")
    text = F.trim(F.coalesce("error_text", F.lit("")))
    d = rows.select(key, "ts", "tool_name", "error_type", "session_id", text.alias("text"), place.alias("at"))
    out = d.groupBy(key).agg(F.count("*").alias("error_count"), F.count_distinct("session_id").alias("session_count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))

    def listed(found: DataFrame, value: str, order: list[Column], name: str, n: int) -> DataFrame:
        best = found.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
        values = F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value])
        return best.groupBy(F.col(key).alias("_k")).agg(values.alias(name))

    often = lambda c: d.where(F.coalesce(c, F.lit("")) != "").groupBy(key, c).agg(F.count("*").alias("n"))
    by_count = lambda c: [F.col("n").desc(), F.col(c)]
    said = d.where("text <> ''").groupBy(key, F.lower(F.substring("text", 1, 80)).alias("_p")).agg(F.min("at").alias("at"), F.min_by(F.substring("text", 1, 200), "at").alias("text"))
    for part in (
        listed(often("tool_name"), "tool_name", by_count("tool_name"), "top_tools", top), listed(said, "text", [F.col("at")], "top_messages", top), listed(often("error_type"), "error_type", by_count("error_type"), "kinds", 1),
    ):
        out = out.join(part, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    surface = F.coalesce(F.create_map(*[F.lit(x) for pair in SURFACES.items() for x in pair])[F.get("kinds", 0)], F.lit("claude_md_rule"))
    none = F.array().cast("array<string>")
    return out.select(key, "error_count", "session_count", "earliest", "latest", F.coalesce("top_tools", none).alias("top_tools"), F.coalesce("top_messages", none).alias("top_messages"), surface.alias("surface"))


def file_hashes(spark: SparkSession, path: str, glob: str = "*", most: int = 1 << 30) -> DataFrame:
    """(path, sha) of every file: sha256 of the content up to ``most`` bytes, beyond that a mark of path and time of change.

    The bound on the length reaches the source, which never opens longer files;
    empty files, which it passes over, give no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    mark = F.concat(F.lit("__size_exceeded__"), F.substring(F.sha2(F.concat("path", (F.unix_millis("modificationTime") / 1000).cast("string")), 256), 1, 32))
    small = files.where(F.col("length") <= most).select("path", F.sha2("content", 256).alias("sha"))
    return small.unionByName(files.where(F.col("length") > most).select("path", mark.alias("sha")))
