"""What became of rules, suggestions and experiments: snapshots, effects, cohorts, assertions, queues and labels.

Windows and "now" are arguments throughout; error kinds are a closed set of some dozens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions import text as t

# Surfaces by their weight; rule files by tool.
LIGHT_SURFACES = ("claude_md_rule", "agent_profile")
TARGETS = (("claude_md_rule", "CLAUDE.md"), ("hook_config", ".claude/hooks/"), ("skill_update", ".claude/skills/"))


def of(kind: str, n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), total), F.lit(0.0)).alias(kind)


def snapshots(errors: DataFrame, kind: str, applied: DataFrame) -> DataFrame:
    """T5: a row for each kind and day: its count, its share of the day's errors, whether a rule was in force.  applied(kind, since, suggestion_id)."""
    day = F.date_trunc("day", "ts").alias("created_at")
    by = errors.groupBy(F.col(kind).alias("kind"), day).agg(F.count("*").alias("n"))
    d = by.withColumn("total", F.sum("n").over(Window.partitionBy("created_at"))).join(applied, "kind", "left")
    on = F.coalesce(F.col("created_at") >= F.col("since"), F.lit(False))
    return d.select("kind", "created_at", "n", of("rate", F.col("n"), F.col("total")), on.alias("rule_applied"), F.when(on, F.col("suggestion_id")).alias("suggestion_id"))


def appended(store: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """T5: the store with the new rows; a key that is there already stays as it is."""
    return store.unionByName(new.join(store.select(*key), key, "left_anti"))


def correction_decay(errors: DataFrame, kind: str, applied: DataFrame, as_of: Column, days: int) -> DataFrame:
    """For each kind with a rule, (rate before - rate now) / rate before, over windows of ``days`` days, ends included.

    Whole days of a window come from counts by day; only its first and last day meet rows, by an equi-join.
    """
    span = F.make_dt_interval(F.lit(days))
    window = lambda name, hi: F.struct(F.lit(name).alias("name"), (hi - span).alias("lo"), hi.alias("hi"))
    windows = applied.select("kind", F.explode(F.array(window("before", F.col("since")), window("now", as_of.cast("timestamp_ntz")))).alias("w")).select("kind", "w.*")
    rows = errors.select("ts", F.col(kind).alias("own"), F.to_date("ts").alias("day"))
    first, last = F.to_date("lo"), F.to_date("hi")
    inner = F.when(F.datediff(last, first) > 1, F.sequence(F.date_add(first, 1), F.date_sub(last, 1)))
    whole = windows.withColumn("day", F.explode(inner)).join(rows.groupBy("day", "own").agg(F.count("*").alias("n")), "day").select("kind", "name", "own", "n")
    edges = windows.withColumn("day", F.explode(F.array_distinct(F.array(first, last)))).join(rows, "day").where((F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi")))
    d = whole.union(edges.select("kind", "name", "own", F.lit(1).cast("long")))
    total = lambda name, own: F.coalesce(F.sum(F.when((F.col("name") == name) & own, F.col("n"))), F.lit(0))
    same = F.col("own") == F.col("kind")
    d = d.groupBy("kind").agg(of("pre_rate", total("before", same), total("before", F.lit(True))), of("rate", total("now", same), total("now", F.lit(True))))
    return d.withColumn("decay", F.coalesce(F.try_divide(F.col("pre_rate") - F.col("rate"), F.col("pre_rate")), F.lit(0.0)))


def trends(snaps: DataFrame) -> DataFrame:
    """Each kind's history in order, with the change since the snapshot before."""
    w = Window.partitionBy("kind").orderBy("created_at")
    return snaps.select("kind", "created_at", "rate", F.row_number().over(w).alias("place"), (F.col("rate") - F.lag("rate").over(w)).alias("change"))


def skill_effects(suggestions: DataFrame, members: DataFrame, snaps: DataFrame) -> DataFrame:
    """For each suggestion(suggestion_id, pattern_id) its pattern's most frequent kind and that kind's mean rate
    before and from the first snapshot under its own rule on; first and last rate where there is no such snapshot.  members(pattern_id, kind)."""
    counts = members.groupBy("pattern_id", "kind").agg(F.count("*").alias("n"))
    top = counts.groupBy("pattern_id").agg(F.min_by("kind", F.struct((-F.col("n")).alias("m"), "kind")).alias("kind"))
    s = suggestions.join(top, "pattern_id", "left")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("created_at"))
    own = snaps.select("kind", "created_at", "rate", "rule_applied", F.col("suggestion_id").alias("by"), place.alias("place"))
    d = s.join(own, "kind", "left")
    first = F.min(F.when((F.col("by") == F.col("suggestion_id")) & F.col("rule_applied"), F.col("place"))).over(Window.partitionBy("suggestion_id"))
    d = d.withColumn("from", F.when(first > 1, first)).groupBy("suggestion_id", "kind").agg(
        F.count("place").alias("tracked"), F.avg(F.when(F.col("place") < F.col("from"), F.col("rate"))).alias("before"), F.avg(F.when(F.col("place") >= F.col("from"), F.col("rate"))).alias("after"),
        F.min_by("rate", "created_at").alias("first"), F.max_by("rate", "created_at").alias("last"),
    )
    pre, post = F.coalesce("before", "first"), F.coalesce("after", "last")
    gain = F.when(pre.isNull(), None).when((pre > 0) & (F.col("tracked") > 1), (pre - post) / pre * 100).otherwise(0.0)
    return d.select("suggestion_id", "kind", F.round(pre, 4).alias("pre_rate"), F.round(post, 4).alias("post_rate"), F.round(gain, 1).alias("improvement_pct"), "tracked")


def declining(snaps: DataFrame) -> DataFrame:
    """Kinds whose latest rate under a rule is above the first."""
    d = snaps.where("rule_applied").groupBy("kind").agg(F.min_by("rate", "created_at").alias("first"), F.max_by("rate", "created_at").alias("latest"))
    return d.where("latest > first")


def experiments(log: DataFrame) -> DataFrame:
    """log(name, op, ts) -> one row per experiment: the first opening counts, then the first closing after it."""
    start = F.min(F.when(F.col("op") == "open", F.col("ts"))).over(Window.partitionBy("name"))
    d = log.withColumn("start_ts", start).where("start_ts is not null").groupBy("name", "start_ts").agg(F.min(F.when((F.col("op") == "close") & (F.col("ts") >= F.col("start_ts")), F.col("ts"))).alias("close_ts"))
    return d.withColumn("status", F.when(F.col("close_ts").isNull(), "open").otherwise("closed"))


def windows(runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The window of each experiment (its close, or now) and the baseline of ``days`` days before it."""
    span = F.make_dt_interval(F.lit(days))
    return runs.select("name", "status", F.col("start_ts").alias("lo"), F.coalesce("close_ts", now).alias("hi"), (F.col("start_ts") - span).alias("base_lo"), F.col("start_ts").alias("base_hi"))


def cohort_report(runs: DataFrame, errors: DataFrame, kind: str, suggestions: DataFrame) -> DataFrame:
    """For each window(name, lo, hi, base_lo, base_hi): errors and hourly rates in it and in the baseline, kinds that are new, and the
    suggestions whose pattern has a member in it.  Days bring windows and errors together, so that only neighbours are compared."""
    days = F.explode(F.sequence(F.to_date("base_lo"), F.to_date("hi")))
    spread = runs.withColumn("day", days)
    e = errors.select(F.to_date("ts").alias("day"), "ts", F.col(kind).alias("kind"), "pattern_id")
    inside, base = (F.col("ts") >= F.col("lo")) & (F.col("ts") <= F.col("hi")), (F.col("ts") >= F.col("base_lo")) & (F.col("ts") < F.col("base_hi"))
    met = spread.join(e, "day").select("name", "kind", "pattern_id", inside.alias("i"), base.alias("b"))
    kinds = met.groupBy("name", "kind").agg(F.count_if("i").alias("i"), F.count_if("b").alias("b"))
    counts = kinds.groupBy("name").agg(F.sum("i").alias("errors"), F.sum("b").alias("base_errors"), F.count_if((F.col("i") > 0) & (F.col("b") == 0)).alias("new_kinds"))
    # Suggestions of the same patterns stand together, as one row with their number, so that no suggestion meets a window by itself.
    alike = suggestions.where("suggestion_id is not null and pattern_id is not null").groupBy("suggestion_id").agg(F.array_sort(F.collect_set("pattern_id")).alias("patterns")).groupBy("patterns").agg(F.count("*").alias("suggestions"))
    held = met.where("i").select("name", "pattern_id").distinct().join(alike.select("patterns", "suggestions", F.explode("patterns").alias("pattern_id")), "pattern_id")
    scoped = held.select("name", "patterns", "suggestions").distinct().groupBy("name").agg(F.sum("suggestions").alias("suggestions"))
    hours = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b)) / 3600
    rate = lambda n, a, b: F.coalesce(F.try_divide(F.col(n).cast("double"), hours(a, b)), F.lit(0.0))
    d = runs.join(counts, "name", "left").join(scoped, "name", "left").fillna(0, ["errors", "base_errors", "new_kinds", "suggestions"])
    now, old = rate("errors", "lo", "hi"), rate("base_errors", "base_lo", "base_hi")
    return d.select("name", "errors", "base_errors", F.round(now, 4).alias("per_hour"), F.round(old, 4).alias("base_per_hour"), F.round(F.try_divide(now - old, old) * 100, 1).alias("delta_pct"), "new_kinds", "suggestions")


def config_hashes(files: DataFrame, root: str = "root") -> DataFrame:
    """files(root, path, content) -> one hash for each root over its markdown files, in order of their paths."""
    line = F.concat("path", F.lit("="), F.sha2(F.coalesce("content", F.lit("")), 256))
    d = files.where(F.endswith("path", F.lit(".md"))).groupBy(root).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("m"))
    return d.select(root, "n_files", F.sha2("m", 256).alias("config_hash"))


def resolutions(errors: DataFrame, least: int = 4) -> DataFrame:
    """Signatures (project, command, kind) seen often: recurring over three sessions, passed by, or undecided; the last member is the anchor."""
    bypass = F.coalesce(F.get_json_object("tool_input", "$.command").rlike(f"(?i){t.BYPASSES}"), F.lit(False))
    d = errors.groupBy("project_tag", "command_category", "error_type").agg(
        F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.bool_or(bypass).alias("suppression"), F.max_by("id", F.struct("ts", "id")).alias("anchor"),
    )
    return d.where(F.col("n") >= least).withColumn("resolution", F.when(F.col("sessions") >= 3, "RECURRING").when(F.col("suppression"), "BYPASS").otherwise("UNDECIDED"))


# Assertions over a frame of one row a subject; each gives passed, actual and threshold.
ASSERTIONS: dict[str, Callable[[float], tuple[Column, Column, Column]]] = {
    "error_rate_decreased": lambda x: (F.col("post_rate") <= F.col("pre_rate"), F.col("post_rate"), F.col("pre_rate")),
    "no_new_regressions": lambda x: (F.size(F.array_except("post_kinds", "pre_kinds")) == 0, F.size(F.array_except("post_kinds", "pre_kinds")).cast("double"), F.lit(0.0)),
    "confidence_above_threshold": lambda x: (F.col("confidence") >= x, F.col("confidence"), F.lit(x)),
    "budget_within_limits": lambda x: (F.col("n_lines") <= x, F.col("n_lines").cast("double"), F.lit(x)),
}
DEFAULTS = {"confidence_above_threshold": 0.7, "budget_within_limits": 100.0}


def run_assertions(subjects: DataFrame, names: list[str]) -> DataFrame:
    """The named assertions for each subject; an unknown name is one that failed."""
    results = []
    for name in names:
        passed, actual, threshold = ASSERTIONS[name](DEFAULTS.get(name, 0.0)) if name in ASSERTIONS else (F.lit(False), F.lit(0.0), F.lit(0.0))
        results.append(F.struct(F.lit(name).alias("name"), passed.alias("passed"), actual.alias("actual"), threshold.alias("threshold")))
    return subjects.select("subject", F.explode(F.array(*results)).alias("r")).select("subject", "r.*")


def auto_suggestions(patterns: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Strong patterns that no suggestion names yet."""
    return patterns.where("grade = 'strong'").join(suggestions.select("pattern_id"), "pattern_id", "left_anti")


def change_type(tool: Column, known: tuple[str, ...]) -> Column:
    """What kind of change a pattern of that tool asks for."""
    low = F.lower(F.coalesce(tool, F.lit("")))
    rule = F.lit(False)
    for k in known:
        rule = rule | F.contains(low, F.lit(k))
    return F.when(rule, "tool_rule").when(F.contains(low, F.lit("hook")), "hook_config").when(F.contains(low, F.lit("skill")), "skill_update").when(~low.isin("", "unknown", "unknown tool"), "tool_rule").otherwise("claude_md_rule")


def target_file(tool: Column, change: Column, known: tuple[str, ...]) -> Column:
    """The file that the change goes to."""
    low = F.lower(F.coalesce(tool, F.lit("")))
    name = F.replace(F.replace(F.substring_index(F.replace(low, F.lit("mcp__"), F.lit("")), "__", 1), F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_"))
    own = F.concat(F.lit(".claude/rules/tools/"), F.when(name != "", F.concat(name, F.lit(".md"))).otherwise(""))
    for k in reversed(known):
        own = F.when(F.contains(low, F.lit(k)), f".claude/rules/tools/{k}.md").otherwise(own)
    other = F.lit("CLAUDE.md")
    for kind, path in TARGETS:
        other = F.when(change == kind, path).otherwise(other)
    return F.when(change == "tool_rule", own).otherwise(other)


def mode(confidence: Column, surface: Column) -> Column:
    """Sure changes of light surfaces go by themselves."""
    return F.when((confidence >= 0.8) & surface.isin(*LIGHT_SURFACES), "auto").otherwise("hitl")


def optimiser(asked: Column, examples: Column, many: int = 50) -> Column:
    """R17: "auto" means the second tier once there are many examples."""
    return F.when(asked != "auto", asked).when(examples >= many, "miprov2").otherwise("bootstrap")


def tally(suggestions: DataFrame, approve_above: float | None = None) -> DataFrame:
    """Outcomes of the suggestions that are not rejected or superseded, and the verdict of the run."""
    score = F.coalesce("arena_score", "confidence", F.lit(0.0)).cast("double")
    up = (F.col("arena_passed") == 1) & (score >= approve_above) if approve_above is not None else F.lit(False)
    out = F.when(F.coalesce(up, F.lit(False)), "promoted").when(F.coalesce(F.col("arena_passed") == 0, F.lit(False)), "rejected_arena").otherwise("pending_approval")
    d = suggestions.where("status <> 'rejected' and coalesce(superseded_at, '') = ''").select(out.alias("o"), score.alias("s"))
    names = ("promoted", "pending_approval", "rejected_arena")
    d = d.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("o") == n).alias(n) for n in names], F.coalesce(F.round(F.avg("s"), 4), F.lit(0.0)).alias("average"))
    verdict = F.lit("no_candidates")
    for n in reversed(names):
        verdict = F.when(F.col(n) > 0, n).otherwise(verdict)
    return d.withColumn("outcome", verdict)


def review_queue(suggestions: DataFrame, n: int) -> DataFrame:
    """The first n pending suggestions, the surest first."""
    return suggestions.where("status = 'pending'").orderBy(F.col("confidence").desc(), "suggestion_id").limit(n)


def training_rows(calls: DataFrame, least: int = 10) -> DataFrame:
    """H8: labelled calls whose message is there, of skills and platforms with at least ``least`` of them."""
    d = calls.where("(user_satisfied is not null or labelled_by is not null) and message <> '[UNAVAILABLE]'")
    return d.withColumn("_n", F.count("*").over(Window.partitionBy("skill", "platform"))).where(F.col("_n") >= least).drop("_n")


def labelled(calls: DataFrame, signals: DataFrame) -> DataFrame:
    """H9: calls with the latest signal on each: "++" satisfied, anything else not.  signals(id, signal, at)."""
    last = signals.groupBy("id").agg(F.max_by(F.startswith("signal", F.lit("++")).cast("int"), "at").alias("new"))
    return calls.join(last, "id", "left").withColumn("user_satisfied", F.coalesce("new", "user_satisfied")).withColumn("labelled_by", F.when(F.col("new").isNotNull(), "batch_review").otherwise(F.col("labelled_by"))).drop("new")


def flagged(flags: DataFrame) -> DataFrame:
    """Skills that were flagged with a note: how often, the latest note."""
    d = flags.where(F.trim("note") != "")
    return d.groupBy("skill").agg(F.count("*").alias("n"), F.max_by(F.trim("note"), "at").alias("note"))


def counters(tables: dict[str, DataFrame], latest: dict[str, str]) -> DataFrame:
    """Rows of each table, and the latest value of a column where one is named."""
    out = None
    for name, df in tables.items():
        last = F.max(latest[name]).cast("string") if name in latest else F.lit(None).cast("string")
        row = df.agg(F.count("*").alias("n"), last.alias("latest")).select(F.lit(name).alias("name"), "n", "latest")
        out = row if out is None else out.unionByName(row)
    return out
