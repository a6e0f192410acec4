"""Flows: recurring tool sequences of sessions, their success and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import short_hash

ARROW = " → "


def runs(stream: DataFrame) -> DataFrame:
    """consecutive equal tools of a session become one run, marked ``+`` if longer than one."""
    order = Window.partitionBy("session_id").orderBy("ts", "id")
    d = stream.withColumn("_new", (F.coalesce(F.lag("tool").over(order), F.lit("")) != F.col("tool")).cast("int"))
    d = d.withColumn("run", F.sum("_new").over(order))
    d = d.groupBy("session_id", "run").agg(
        F.first("tool").alias("tool"), F.count("*").alias("n"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), F.max(F.col("praised").cast("int")).alias("praised") if "praised" in stream.columns else F.lit(0).alias("praised")
    )
    return d.withColumn("key", F.when(F.col("n") > 1, F.concat("tool", F.lit("+"))).otherwise(F.col("tool")))


def praise(stream: DataFrame, tool: str) -> DataFrame:
    """rows before a praising row of their session; the praising rows themselves go."""
    w = Window.partitionBy("session_id").orderBy("ts", "id").rowsBetween(1, Window.unboundedFollowing)
    return stream.withColumn("praised", F.coalesce(F.max(F.col("tool") == tool).over(w), F.lit(False))).where(F.col("tool") != tool)


def ngrams(run_rows: DataFrame, low: int = 2, high: int = 5) -> DataFrame:
    """every sequence of low..high runs, with its hash; success if a member is praised."""
    order = Window.partitionBy("session_id").orderBy("run")
    d = run_rows.withColumn("_keys", F.collect_list("key").over(order.rowsBetween(0, high - 1)))
    d = d.withColumn("_good", F.collect_list("praised").over(order.rowsBetween(0, high - 1)))
    d = d.withColumn("size", F.explode(F.sequence(F.lit(low), F.lit(high)))).where(F.col("size") <= F.size("_keys"))
    seq = F.array_join(F.slice("_keys", 1, F.col("size")), ARROW)
    good = F.array_max(F.slice("_good", 1, F.col("size")))
    return d.select("session_id", "run", "size", "ts", seq.alias("sequence"), good.alias("success")).withColumn("flow_hash", short_hash(F.col("sequence")))


def first_per_session(grams: DataFrame) -> DataFrame:
    """one row per session and flow, the first."""
    w = Window.partitionBy("session_id", "flow_hash").orderBy("size", "run")
    return grams.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def summary(flow_events: DataFrame, least: int = 2) -> DataFrame:
    """counts, success rate, sessions, last seen and confidence tier of each flow."""
    d = flow_events.groupBy("flow_hash", "sequence").agg(
        F.count("*").alias("total"), F.sum("success").cast("long").alias("successes"), F.count_distinct("session_id").alias("sessions"), F.max("ts").alias("last_seen")
    )
    d = d.where(F.col("total") >= least).withColumn("success_rate", F.round(100.0 * F.col("successes") / F.col("total"), 1))
    rate = F.col("success_rate")
    tier = F.when((F.col("total") >= 20) & (rate >= 40), "HIGH").when((F.col("total") >= 10) & (rate >= 20), "MEDIUM").otherwise("LOW")
    return d.withColumn("tier", tier)


def promotable(flow_events: DataFrame, sessions: int = 5, rate: float = 0.7) -> DataFrame:
    """flows of enough sessions that mostly succeed."""
    d = flow_events.groupBy("flow_hash", "sequence").agg(F.count_distinct("session_id").alias("sessions"), F.avg(F.col("success").cast("double")).alias("rate"))
    return d.where((F.col("sessions") >= sessions) & (F.col("rate") > rate)).withColumn("rate", F.round("rate", 4))


def twins(flow_events: DataFrame, least: int = 3) -> DataFrame:
    """flows that both succeed and fail often enough."""
    d = flow_events.groupBy("flow_hash").agg(F.sum("success").cast("long").alias("successes"), F.sum(1 - F.col("success")).cast("long").alias("failures"))
    return d.where((F.col("successes") >= least) & (F.col("failures") >= least))


def next_tools(flow_rows: DataFrame, least: int = 5) -> DataFrame:
    """prefix and next tool at every split of each frequent flow."""
    d = flow_rows.where(F.col("total") >= least).withColumn("_p", F.split("sequence", ARROW))
    d = d.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)))
    return d.select("flow_hash", "cut", F.array_join(F.slice("_p", 1, F.col("cut")), ARROW).alias("prefix"), F.element_at("_p", F.col("cut") + 1).alias("next_tool"), "total")


def paired_samples(flow_events: DataFrame, n: int = 2, seed: str = "7") -> DataFrame:
    """n rows per flow and outcome, by a seeded hash instead of an unseeded draw."""
    key = F.md5(F.concat_ws("|", F.lit(seed), "flow_hash", "session_id"))
    w = Window.partitionBy("flow_hash", "success").orderBy(key, "session_id")
    return flow_events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
