"""Ranking, grading and confidence of patterns; discovery of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_days(ts: Column, as_of: str) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, F.to_timestamp_ntz(F.lit(as_of))) / 8.64e10


def patterns(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pattern: errors, sessions, first and last seen."""
    return stream.groupBy(*keys).agg(F.count("*").alias("error_count"), F.count_distinct("session_id").alias("session_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def rank_score(p: DataFrame, as_of: str) -> DataFrame:
    """Errors over one plus the days since the last."""
    days = F.greatest(age_days(F.col("last_seen"), as_of), F.lit(0.0))
    return p.withColumn("rank_score", F.round(F.col("error_count") / (1 + days), 6))


def decay(last_seen: Column, as_of: str) -> Column:
    """R2: 1 for 14 days, then falling to 0.6 at 28 and to 0.3 at 56; unknown: 0.3."""
    a = age_days(last_seen, as_of)
    return F.when(a.isNull(), 0.3).when(a <= 14, 1.0).when(a <= 28, 1 - 0.4 * (a - 14) / 14).when(a <= 56, 0.6 - 0.3 * (a - 28) / 28).otherwise(0.3)


def confidence(p: DataFrame, as_of: str, examples: str = "error_count") -> DataFrame:
    """Errors, examples and rank weighted, times decay."""
    cover = F.least(F.log1p(F.col(examples).cast("double")) / F.log1p(F.lit(90.0)), F.lit(1.0))
    raw = 0.4 * F.least(F.col("error_count") / 30.0, F.lit(1.0)) + 0.3 * cover + 0.3 * F.greatest(F.lit(0.0), F.least(F.col("rank_score"), F.lit(1.0)))
    return p.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(raw * decay(F.col("last_seen"), as_of), F.lit(1.0))), 6))


def grade(p: DataFrame, as_of: str) -> DataFrame:
    """Declining, established, strong, emerging or null, in this order."""
    n, s = F.col("error_count"), F.col("session_count")
    g = F.when(decay(F.col("last_seen"), as_of) < 0.5, "declining").when((n >= 5) & (age_days(F.col("first_seen"), as_of) >= 7), "established").when((n >= 3) & (s >= 3), "strong").when((n >= 2) & (s >= 2), "emerging")
    return p.withColumn("grade", g)


def live_grade(p: DataFrame, as_of: str) -> DataFrame:
    """By the age of the last error; R6: whether that differs from the grade before."""
    a = age_days(F.col("last_seen"), as_of)
    return p.withColumn("live_grade", F.when(a > 30, "dead").when(a > 7, "declining").otherwise("established")).withColumn("changed", ~F.col("live_grade").eqNullSafe(F.col("grade")))


def micro_patterns(stream: DataFrame, text: str = "k") -> DataFrame:
    """Text and tool within a session, its confidence, and in how many sessions it stands."""
    d = stream.groupBy("session_id", text, "tool").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("session_id")))
    d = d.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("n") / F.col("total") + 0.1 * (F.col("n") - 1)), 6)).where("n >= 2")
    return d.withColumn("sessions", F.count("*").over(Window.partitionBy(text, "tool"))).drop("total")


def recency_weights(rows: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """0.5 to 1 by order of time within a group."""
    w = Window.partitionBy(group)
    i, n = F.row_number().over(w.orderBy(ts, key)) - 1, F.count("*").over(w)
    return rows.withColumn("weight", F.round(F.when(n > 1, 0.5 + 0.5 * i / (n - 1)).otherwise(1.0), 6))


def quality_gates(stream: DataFrame, key: str, examples: int = 10, failures: int = 5, sessions: int = 3) -> DataFrame:
    """The first gate that each key fails, or passed."""
    d = stream.groupBy(key).agg(F.count("*").alias("examples"), F.count_if("is_error").alias("failures"), F.count_distinct(F.when(F.col("is_error"), F.col("session_id"))).alias("failing_sessions"))
    gate = F.when(F.col("examples") < examples, "examples").when(F.col("failures") < failures, "failures").when(F.col("failing_sessions") < sessions, "sessions").otherwise("passed")
    return d.withColumn("gate", gate)


def skill_candidates(stream: DataFrame, flow_rows: DataFrame) -> DataFrame:
    """Per tool its patterns, the flows that name it, kind, confidence and priority."""
    tools = stream.groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.avg((~F.col("is_error")).cast("double")).alias("rate"))
    named = flow_rows.withColumn("tool", F.explode(F.array_distinct(F.transform(F.split("sequence", " → "), lambda x: F.rtrim(x, F.lit("+"))))))
    flows = named.groupBy("tool").agg(F.count("*").alias("flows"))
    d = tools.join(flows, "tool", "left").withColumn("flows", F.coalesce("flows", F.lit(0)))
    score = F.least(F.col("n") / 20, F.lit(0.4)) + F.least(F.col("sessions") / 10, F.lit(0.3)) + F.least(F.col("rate") * 0.3, F.lit(0.3))
    d = d.withColumn("confidence", F.round(score, 3)).withColumn("kind", F.when(F.col("flows") > 0, "workflow").otherwise("tool"))
    return d.withColumn("priority", F.when(F.col("confidence") > 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low")).withColumn("rate", F.round("rate", 6))
