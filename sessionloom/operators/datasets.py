"""Datasets, curation, health, rules, distilling and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_time() -> WindowSpec:
    """Rows of a session in order of time."""
    return Window.partitionBy("session_id").orderBy("ts", "id")


def by_idx() -> WindowSpec:
    """Messages of a session in their order."""
    return Window.partitionBy("session_id").orderBy("idx")


def recoveries(stream: DataFrame) -> DataFrame:
    """Each failure with the next call of its session that is none."""
    nxt = F.first(F.when(~F.col("is_error"), F.struct("id", "tool")), True).over(by_time().rowsBetween(1, Window.unboundedFollowing))
    return stream.withColumn("_next", nxt).where("is_error and _next is not null").select("id", "session_id", F.col("_next.id").alias("next_id"), F.col("_next.tool").alias("next_tool"))


def followed_within(stream: DataFrame, first: Column, second: Column, seconds: int) -> DataFrame:
    """Rows with a ``second`` row of their session within ``seconds`` after them; hours are equal keys of the range join."""
    d = stream.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    width = seconds * 1_000_000
    a = d.where(first).withColumn("_bin", F.explode(F.array(F.floor(F.col("_s") / width), F.floor(F.col("_s") / width) + 1)))
    b = d.where(second).select(F.col("session_id").alias("_sid"), F.col("_s").alias("_t"), F.floor(F.col("_s") / width).alias("_b"))
    hit = (F.col("session_id") == F.col("_sid")) & (F.col("_bin") == F.col("_b")) & (F.col("_t") > F.col("_s")) & (F.col("_t") <= F.col("_s") + width)
    return a.join(b, hit, "left_semi").select(*stream.columns).dropDuplicates(["id"])


def preceded_pairs(stream: DataFrame, error: Column, good: Column, seconds: int) -> DataFrame:
    """An error and each good row of its session that follows within ``seconds``."""
    d = stream.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    width = seconds * 1_000_000
    a = d.where(error).withColumn("_bin", F.explode(F.array(F.floor(F.col("_s") / width), F.floor(F.col("_s") / width) + 1)))
    b = d.where(good).select(F.col("session_id").alias("_sid"), F.col("id").alias("good_id"), F.col("_s").alias("_t"), F.floor(F.col("_s") / width).alias("_b"))
    hit = (F.col("session_id") == F.col("_sid")) & (F.col("_bin") == F.col("_b")) & (F.col("_t") > F.col("_s")) & (F.col("_t") - F.col("_s") < width)
    return a.join(b, hit).select(F.col("id").alias("error_id"), "good_id")


def skill_health(stream: DataFrame) -> DataFrame:
    """H1, H2: labelled and unlabelled calls of each tool; satisfaction over the labelled ones; flagged under a half."""
    d = stream.groupBy("tool").agg(
        F.count("*").alias("total"), F.count_if("satisfied").alias("satisfied"), F.count_if(~F.col("satisfied")).alias("unsatisfied"), F.count_if(F.col("satisfied").isNull()).alias("unlabelled")
    )
    d = d.withColumn("rate", F.round(F.try_divide(F.col("satisfied").cast("double"), F.col("satisfied") + F.col("unsatisfied")), 6))
    return d.withColumn("flagged", F.coalesce(F.col("rate") < 0.5, F.lit(False)))


def failure_surface(stream: DataFrame, key: str, least: int = 3) -> DataFrame:
    """H4 to H6: failures of each key in at least so many sessions, with the sessions."""
    d = stream.where("is_error").groupBy(key).agg(F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_set("session_id")), ",").alias("sessions"), F.count_distinct("session_id").alias("n_sessions"))
    return d.where(F.col("n_sessions") >= least)


def label_skew(labels: DataFrame, label: str) -> DataFrame:
    """H7: share of each label, and a warning over 90 %."""
    d = labels.groupBy(label).agg(F.count("*").alias("n"))
    d = d.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
    return d.withColumn("skewed", F.col("share") > 0.9)


def purged(rows: DataFrame, key: str, day: str, before: str, gold: DataFrame) -> DataFrame:
    """What a purge keeps: rows that are young enough or referenced."""
    old = rows.where(F.col(day) < F.lit(before)).join(gold.select(key).distinct(), key, "left_anti").select(key)
    return rows.join(old, key, "left_anti")


def discipline(stream: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of calls by tool on which each flag is set."""
    return stream.groupBy("tool").agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6).alias(n) for n, c in flags.items()])


def violations(docs: DataFrame, rules: DataFrame, least: int = 2) -> DataFrame:
    """V3, V4: rules of which a text holds ``least`` different terms; only words that some rule has meet it by an equi-join."""
    every = rules.agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("_terms"))  # one row: the terms of the rules in force
    own = F.array_intersect(F.split(F.lower("text"), r"[^a-zà-ÿ]+"), F.col("_terms"))
    d = docs.crossJoin(F.broadcast(every)).select("doc_id", F.explode(own).alias("term"))
    r = rules.select("rule", F.explode(F.array_distinct("terms")).alias("term"))
    hits = d.join(r, "term").groupBy("rule", "doc_id").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") >= least)
    seen = hits.groupBy("rule").agg(F.count("*").alias("violations"), F.max("doc_id").alias("last"))
    return rules.select("rule").join(seen, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), "last", F.col("violations").isNull().alias("compliant"))


def replay(stream: DataFrame, predicate: str, history: int = 5) -> DataFrame:
    """V5: does a SQL predicate over the last tools (``history``, an array) fire before each error?"""
    d = stream.withColumn("history", F.collect_list("tool").over(by_time().rowsBetween(-history, -1))).withColumn("_fires", F.expr(predicate))
    return d.groupBy("session_id").agg(F.count_if("is_error").alias("errors"), F.count_if(F.col("is_error") & F.col("_fires")).alias("caught"), F.count_if(~F.col("is_error") & F.col("_fires")).alias("false_alarms"))


def winning_path(stream: DataFrame) -> DataFrame:
    """Calls that neither failed nor repeat the one before, numbered, with their phase; operators/distill.py goes by outputs, undos and inputs."""
    kept = stream.where("not is_error")
    kept = kept.withColumn("_again", F.coalesce((F.lag("tool").over(by_time()) == F.col("tool")) & (F.lag("k").over(by_time()) == F.col("k")), F.lit(False))).where("not _again").drop("_again")
    n = F.row_number().over(by_time())
    kept = kept.withColumn("step", n).withColumn("_all", F.count("*").over(Window.partitionBy("session_id")))
    done = (F.col("step") - 1) / F.col("_all")
    return kept.withColumn("phase", F.when(done < 0.3, "explore").when(done < 0.8, "implement").otherwise("verify")).drop("_all")


def fixes(stream: DataFrame, ahead: int = 3) -> DataFrame:
    """An error and the first of the next ``ahead`` calls with its key that is clean."""
    d = stream.withColumn("_rest", F.collect_list(F.struct("id", "k", "is_error")).over(by_time().rowsBetween(1, ahead)))
    found = F.filter("_rest", lambda x: ~x["is_error"] & (F.abs(x["k"] - F.col("k")) <= 10))
    return d.where("is_error").withColumn("fix_id", F.get(found, 0)["id"]).where("fix_id is not null").select("id", "session_id", "fix_id")


def topic_with_neighbours(messages: DataFrame, topic: str) -> DataFrame:
    """Messages on a topic with the one before and after, renumbered."""
    d = messages.withColumn("_hit", F.coalesce(F.col("content").rlike(topic), F.lit(False)))
    d = d.withColumn("_near", F.max("_hit").over(by_idx().rowsBetween(-1, 1))).where("_near")
    return d.withColumn("step", F.row_number().over(by_idx())).drop("_hit", "_near")


def windows_around(messages: DataFrame, pattern: str, n: int = 2, most: int = 5) -> DataFrame:
    """Q8: messages within ``n`` of a hit, for the first ``most`` hits of a session."""
    hits = messages.where(F.col("content").rlike(pattern)).withColumn("_r", F.row_number().over(by_idx())).where(F.col("_r") <= most)
    h = hits.select(F.col("session_id").alias("_sid"), F.col("idx").alias("hit_idx"))
    return messages.join(h, (F.col("session_id") == F.col("_sid")) & F.col("idx").between(F.col("hit_idx") - n, F.col("hit_idx") + n)).select("session_id", "hit_idx", "idx", "role")


def skeleton(messages: DataFrame, pattern: str) -> DataFrame:
    """Q7, Q10: hits of each session, the latest, and a snippet of it."""
    d = messages.where(F.col("content").rlike(pattern))
    return d.groupBy("session_id").agg(F.count("*").alias("hits"), F.max("idx").alias("last_idx"), F.max_by(F.substring("content", 1, 80), "idx").alias("snippet"))


def distributions(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distribution over each key by itself, in one pass of grouping sets."""
    d = rows.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    kind = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in keys])
    return d.select(kind.alias("dimension"), F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.col(k).cast("string")) for k in keys]).alias("entry"), "n", "total")


def dataset_counts(bridge: DataFrame, facts: DataFrame, least: int = 5) -> DataFrame:
    """Members of each pattern with their labels; patterns of at least so many."""
    d = bridge.join(facts, "error_id").groupBy("pattern_id").agg(F.count("*").alias("examples"), F.sum("label").cast("long").alias("positive"), F.min("day").alias("first"), F.max("day").alias("last"))
    return d.where(F.col("examples") >= least)


def latest_per_source(sources: dict[str, DataFrame], n: int) -> DataFrame:
    """Sources under one schema, the newest ``n`` of each."""
    out = None
    for name, d in sources.items():
        d = d.select(F.lit(name).alias("source"), F.col("session_id").cast("string"), F.col("at").cast("long"), "body")
        out = d if out is None else out.unionByName(d)
    w = Window.partitionBy("source").orderBy(F.col("at").desc_nulls_last(), "session_id", "body")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
