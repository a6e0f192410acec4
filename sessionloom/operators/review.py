"""Chunks, forward windows, browsing, linkage of changes and report summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(docs: DataFrame, doc_id: str, text: str, width: int = 500) -> DataFrame:
    """Q16: a text cut before its headings, each part into slices of ``width`` characters; blank slices go."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)(?=^#{1,6} )"), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), ((F.length(p) - 1) / width).cast("int")), lambda i: F.substr(p, i * width + 1, F.lit(width))))
    return docs.select(doc_id, F.posexplode(F.flatten(cut)).alias("chunk", "body")).where(F.trim("body") != "")


def forward_window(stream: DataFrame, anchor: Column, n: int) -> DataFrame:
    """Q17: each anchor row with the tools of the next n rows of its session."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(1, n)
    return stream.withColumn("following", F.collect_list("tool").over(w)).where(anchor).select("id", "session_id", F.array_join("following", ">").alias("following"))


def located(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Q17: anchors(anchor_id, session_id, anchor_ts, tool_name) -> anchors with ``row_id``, that of their row among rows(session_id, id, ts, tool_name).

    First a row of that instant and tool, then one of that instant, then the first one later; of several the least id, null without any.
    Both sides are put in one order of time by session, so an anchor that falls between rows finds the next.
    """
    named = rows.groupBy("session_id", F.col("ts").alias("anchor_ts"), "tool_name").agg(F.min("id").alias("_same"))
    both = anchors.select("session_id", F.col("anchor_ts").alias("ts"), F.lit(0).alias("_side"), "anchor_id", F.lit(None).cast("long").alias("id"), "tool_name").unionByName(
        rows.select("session_id", "ts", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("anchor_id"), F.col("id").cast("long").alias("id"), F.lit(None).cast("string").alias("tool_name"))
    )
    w = Window.partitionBy("session_id").orderBy("ts", "_side", "id", "anchor_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    next_ = both.withColumn("_next", F.first("id", True).over(w)).where("_side = 0").withColumnRenamed("ts", "anchor_ts")
    return next_.join(named, ["session_id", "anchor_ts", "tool_name"], "left").select("anchor_id", "session_id", "anchor_ts", "tool_name", F.coalesce("_same", "_next").alias("row_id"))


def turn_text(rows: DataFrame) -> Column:
    """Q17: a turn as one line, a call with how it ended; null for a turn that says nothing."""
    flat = lambda c, n: F.replace(F.substring(F.coalesce(c, F.lit("")), 1, n), F.lit("\n"), F.lit(" "))
    result = F.coalesce(F.nullif(rows["output"], F.lit("")), rows["error"])
    ended = F.when(F.coalesce(rows["error"], F.lit("")) == "", "OK").otherwise("ERR")
    call = F.concat(F.lit("["), "role", F.lit("/"), "tool_name", F.lit("/"), ended, F.lit("] "), flat(rows["tool_input"], 160), F.lit(" → "), flat(result, 240))
    said = flat(F.trim(rows["content"]), 280)
    return F.when(F.coalesce(rows["tool_name"], F.lit("")) != "", call).when(said != "", F.concat(F.lit("["), F.coalesce("role", F.lit("?")), F.lit("] "), said))


def located_windows(anchors: DataFrame, rows: DataFrame, n: int = 12, most: int = 2200) -> DataFrame:
    """Q17: anchors with the text of the n turns after their row, ``most`` characters at most; "" where no row is found or nothing follows."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(1, n)
    text = rows.withColumn("_text", turn_text(rows)).select("session_id", F.col("id").alias("row_id"), F.substring(F.array_join(F.collect_list("_text").over(w), "\n"), 1, most).alias("following"))
    return located(anchors, rows).join(text, ["session_id", "row_id"], "left").withColumn("following", F.coalesce("following", F.lit("")))


def latest_of(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """Q18: the latest n rows of each type with the type's count."""
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(kind).orderBy(F.col("ts").desc(), F.col("id").desc())
    newest = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return newest.join(counts, kind)


def linked_change(kinds: DataFrame, changes: DataFrame) -> DataFrame:
    """For each type the latest change that is not rolled back and names it; kinds is a short, stated list.

    changes(id, applied_at, rolled_back, text).
    """
    live = changes.where("not rolled_back").select("id", "applied_at", F.lower("text").alias("_t"))
    every = kinds.agg(F.collect_set("kind").alias("_kinds"))  # one row
    named = F.filter("_kinds", lambda k: F.contains(F.col("_t"), F.lower(k)))
    hit = live.crossJoin(F.broadcast(every)).select("id", "applied_at", F.explode(named).alias("kind"))
    return hit.groupBy("kind").agg(F.max_by("id", F.struct("applied_at", "id")).alias("change_id"), F.count("*").alias("changes"))


def report_summary(metrics: DataFrame) -> DataFrame:
    """One row over metrics(tokens, cost, errors, cache_ratio), nulls as 0."""
    zero = F.lit(0)
    return metrics.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("tokens"), zero).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"),
        F.coalesce(F.sum("errors"), zero).alias("errors"), F.round(F.coalesce(F.avg("cache_ratio"), F.lit(0.0)), 6).alias("cache_ratio"),
    )


def dataset_summary(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """First and last instant, examples, and the k most frequent tools of each dataset."""
    each = rows.groupBy(key, "tool").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("tool").alias("t")))), 1, k)
    return each.groupBy(key).agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_join(F.transform(best, lambda x: x["t"]), ",").alias("top"))


def truth_stats(rows: DataFrame, label: str, surface: str) -> DataFrame:
    """Counts by label and by surface, in one pass."""
    return rows.groupingSets([[label], [surface]], label, surface).agg(F.count("*").alias("n"))


def changes_listing(changes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Every change with its suggestion, if it has one."""
    return changes.join(suggestions, "suggestion_id", "left")


def routing(messages: DataFrame) -> DataFrame:
    """(message, context) -> next role: texts cut at 500 and 300 characters."""
    w = Window.partitionBy("session_id").orderBy("idx")
    d = messages.withColumn("context", F.coalesce(F.lag("content").over(w), F.lit(""))).withColumn("route", F.lead("role").over(w)).where("role = 'user' and route is not null")
    return d.select("session_id", "idx", F.substring("content", 1, 500).alias("message"), F.substring("context", 1, 300).alias("context"), "route")


def phases(stream: DataFrame) -> DataFrame:
    """Explore, implement or verify by the place in the session; one row per session and phase."""
    w = Window.partitionBy("session_id")
    p = (F.row_number().over(w.orderBy("ts", "id")) - 1) / F.count("*").over(w)
    d = stream.withColumn("phase", F.when(p < 0.3, "explore").when(p < 0.8, "implement").otherwise("verify"))
    return d.groupBy("session_id", "phase").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


def unprocessed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """files(path, content) whose path and hash are not in seen(path, sha)."""
    return files.withColumn("sha", F.sha2(F.coalesce("content", F.lit("")), 256)).join(seen, ["path", "sha"], "left_anti").select("path", "sha")


def superseded(rows: DataFrame, key: str, cycle: str) -> DataFrame:
    """Rows of a key's latest cycle stay active."""
    return rows.withColumn("active", F.col(cycle) == F.max(cycle).over(Window.partitionBy(key)))
