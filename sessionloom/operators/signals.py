"""Signals over the messages and tool calls of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sessionloom.functions import text as t


def by_time() -> WindowSpec:
    """Rows of a session in order of time."""
    return Window.partitionBy("session_id").orderBy("ts", "id")


def by_idx() -> WindowSpec:
    """Messages of a session in their order."""
    return Window.partitionBy("session_id").orderBy("idx")


def corrections(messages: DataFrame) -> DataFrame:
    """User messages that correct; a bare "no," counts at a start or after white space."""
    hit = t.any_of(F.col("content"), t.CORRECTION) | F.coalesce(F.col("content").rlike(r"(?i)(^|\s)no,"), F.lit(False))
    return messages.where(F.col("role").isin("user", "human") & hit)


def acting(text: Column) -> Column:
    """L8: "undo" or "correction" where a prompt asks for one, else null; undoing words go first."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    undoing = F.lit(False)
    for word in t.UNDOING:
        undoing = undoing | F.contains(low, F.lit(word))
    return F.when(undoing, "undo").when(t.starts_with_any(low, t.CORRECTING), "correction")


def undos(messages: DataFrame) -> DataFrame:
    """User messages that take something back; "git push" is deleted before the test."""
    text = F.regexp_replace("content", r"(?i)git\s+push", "")
    return messages.where(F.col("role").isin("user", "human") & t.any_of(text, t.UNDO))


def admissions(messages: DataFrame) -> DataFrame:
    """E5: assistant messages that admit a mistake, with a 200-character snippet."""
    snippet = F.when(F.length("content") > 200, F.concat(F.substring("content", 1, 200), F.lit("..."))).otherwise(F.col("content"))
    return messages.where((F.col("role") == "assistant") & t.any_of(F.col("content"), t.ADMISSION)).withColumn("snippet", snippet)


def labels(texts: DataFrame, text: str) -> DataFrame:
    """Zero or more labels of the agent's state per row."""
    return texts.withColumn("label", F.explode(F.array_compact(F.array(*[F.when(t.any_of(F.col(text), p), n) for n, p in t.STATES]))))


def sentiments(messages: DataFrame) -> DataFrame:
    """Score of each message."""
    return messages.withColumn("score", F.round(t.sentiment(F.col("content")), 6))


def frustration(messages: DataFrame) -> DataFrame:
    """User messages at the end of three negative ones in a row, or with an escalation phrase."""
    m = messages.where("role = 'user'").withColumn("score", t.sentiment(F.col("content")))
    three = (F.col("score") < 0) & (F.lag("score", 1).over(by_idx()) < 0) & (F.lag("score", 2).over(by_idx()) < 0)
    return m.withColumn("streak", F.coalesce(three, F.lit(False))).withColumn("escalated", t.escalated(F.col("content")))


def positive_kind(content: Column, prior: Column) -> Column:
    """Confirmation, gratitude, or implicit approval: under 20 words, positive and not negative, where ``prior`` holds."""
    words = F.size(F.filter(F.split(F.trim(content), r"\s+"), lambda w: w != ""))
    return (
        F.when(t.any_of(content, t.CONFIRMATION), "confirmation").when(t.any_of(content, t.GRATITUDE), "gratitude")
        .when(prior & (words < 20) & (t.hits(content, t.POSITIVE) > 0) & (t.negatives(content) == 0), "implicit_approval")
    )


def positives(messages: DataFrame) -> DataFrame:
    """E13 over a dialogue: the first kind that fits each user message; approval asks for an assistant's message before."""
    prior = F.coalesce(F.max(F.col("role") == "assistant").over(by_idx().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return messages.withColumn("_prior", prior).where("role = 'user'").withColumn("kind", positive_kind(F.col("content"), F.col("_prior"))).drop("_prior")


def neighbours(messages: DataFrame) -> DataFrame:
    """Contents before and after, the last user message and the last assistant message."""
    before = by_idx().rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("content")), True).over(before)
    return messages.select("*", F.lag("content").over(by_idx()).alias("before"), F.lead("content").over(by_idx()).alias("after"), last("user").alias("last_user"), last("assistant").alias("last_assistant"))


def repeated_attempts(stream: DataFrame, reset: str) -> DataFrame:
    """The third call in a row of one tool; rows of the ``reset`` tool end a row, once per run."""
    d = stream.withColumn("_new", (F.coalesce(F.lag("tool").over(by_time()), F.lit("")) != F.col("tool")).cast("int")).withColumn("_run", F.sum("_new").over(by_time()))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("session_id", "_run").orderBy("ts", "id")))
    return d.where((F.col("_n") == 3) & (F.col("tool") != reset)).drop("_new", "_run", "_n")


def quick_redo(stream: DataFrame, seconds: int) -> DataFrame:
    """Calls of the same tool within ``seconds`` of the one before."""
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(by_time()), F.col("ts"))
    same = F.lag("tool").over(by_time()) == F.col("tool")
    return stream.withColumn("_gap", gap).withColumn("_same", same).where(F.col("_same") & (F.col("_gap") <= seconds * 1_000_000)).drop("_gap", "_same")


def reinvoked(stream: DataFrame, same: str = "k", other: str = "tool", back: int = 4) -> DataFrame:
    """One of the ``back`` rows before has the same message and another action."""
    hit = F.lit(False)
    for i in range(1, back + 1):
        hit = hit | F.coalesce((F.lag(same, i).over(by_time()) == F.col(same)) & (F.lag(other, i).over(by_time()) != F.col(other)), F.lit(False))
    return stream.withColumn("_hit", hit).where("_hit").drop("_hit")


def approvals(stream: DataFrame, response: str, rejected: str = "k % 3 = 0") -> DataFrame:
    """Each call with the next response row of its session, rejected by an expression; none means approved; rates by tool.  mining.approvals_by_response reads the response."""
    after = by_time().rowsBetween(1, Window.unboundedFollowing)
    d = stream.withColumn("_no", F.first(F.when(F.col("tool") == response, F.expr(rejected)), True).over(after)).where(F.col("tool") != response)
    d = d.groupBy("tool").agg(F.count_if(~F.coalesce("_no", F.lit(False))).alias("approved"), F.count_if("_no").alias("rejected"))
    return d.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("approved").cast("double"), F.col("approved") + F.col("rejected")), F.lit(0.0)), 6))


def session_metrics(stream: DataFrame) -> DataFrame:
    """One row per session: counts, sums, duration, modal tool and counts by tool."""
    d = stream.groupBy("session_id", "tool").agg(F.count("*").alias("n"), F.sum("amount").alias("a"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return d.groupBy("session_id").agg(
        F.sum("n").alias("calls"), F.round(F.sum("a"), 4).alias("amount"), F.sum(F.when(F.col("tool") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.timestamp_diff("SECOND", F.min("lo"), F.max("hi")).alias("seconds"), F.max_by("tool", F.struct("n", "tool")).alias("modal_tool"),
        F.array_join(F.array_sort(F.collect_list(F.concat("tool", F.lit("="), F.col("n").cast("string")))), ",").alias("by_tool"),
    )


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; rows that lack part of the key all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    return rows.withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | lacking).drop("_r")


def new_only(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key isn't stored yet, each key once."""
    return first_per_key(rows.join(stored.select(*keys), keys, "left_anti"), keys, order)


def tool_mastery(stream: DataFrame) -> DataFrame:
    """Distinct tools and success rate of a session, in bands."""
    d = stream.groupBy("session_id").agg(F.count_distinct("tool").alias("tools"), F.avg((~F.col("is_error")).cast("double")).alias("rate"))
    band = F.when((F.col("tools") >= 5) & (F.col("rate") >= 0.8), "high").when((F.col("tools") >= 3) & (F.col("rate") >= 0.5), "medium").otherwise("low")
    return d.withColumn("mastery", band).withColumn("rate", F.round("rate", 6))


def complexity(messages: DataFrame) -> DataFrame:
    """Messages times ln(tokens), in bands; E20: mean sentiment in bands."""
    d = messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("tokens"), F.avg(t.sentiment(F.col("content"))).alias("mean"))
    d = d.withColumn("score", F.round(F.col("messages") * F.ln(F.greatest("tokens", F.lit(1))), 6))
    band = F.when(F.col("score") < 50, "simple").when(F.col("score") < 200, "moderate").otherwise("complex")
    mood = F.when(F.col("mean") > 0.3, "satisfied").when(F.col("mean") < -0.3, "unsatisfied").otherwise("neutral")
    return d.select("session_id", "messages", "tokens", "score", band.alias("band"), mood.alias("mood"))
