"""Live operators: table streams, digests and windows.

The sources of tables see new files; ``sources.tail`` sees bytes added to old
ones.  Watermarks and event-time windows are additions of this build.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionloom.operators.store import shared_dir
from sessionloom.sources.bind import TALK_COLUMNS, TRACE_COLUMNS
from sessionloom.streaming.state import STORE

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _files(spark: SparkSession, schema: str | StructType, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a stream takes a single file only by a pattern."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: the events table as a stream of tool calls."""
    e = _files(spark, EVENTS, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"), "ts", F.col("value").alias("amount"), (F.col("event_type") == "error").alias("is_error"))


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _files(spark, spark.read.parquet(f"{sf_dir}/{name}.parquet").schema, sf_dir, name)


def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of session traces."""
    return _table_stream(spark, sf_dir, "events").selectExpr(*TRACE_COLUMNS)


def talk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as a stream of messages, a minute apart."""
    d = _table_stream(spark, sf_dir, "conversations").selectExpr(*TALK_COLUMNS)
    return d.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + 60 * F.col("idx")))


def live_filter(stream: DataFrame, tools: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """L3: tools, ``since`` exclusive, ``until`` inclusive; the same for batches and streams."""
    if tools is not None:
        stream = stream.where(F.col("tool").isin(*tools))
    if since:
        stream = stream.where(F.col("ts") > F.to_timestamp_ntz(F.lit(since)))
    return stream.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(until))) if until else stream


def digest(stream: DataFrame) -> DataFrame:
    """L4: calls, errors and the last instant of each tool."""
    return stream.groupBy("tool").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.max("ts").alias("cursor"))


def windowed(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """An addition: calls per event-time window, closed by a watermark; needs a zoned instant."""
    d = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return d.groupBy(F.window("at", width), "tool").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tool", "n")


def finalised(stream: DataFrame, late: str = "1 hour", gap: str = "12 hours") -> DataFrame:
    """One row for each session that has ended: no call for ``gap``, closed by a watermark; given out once."""
    d = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    d = d.groupBy("session_id", F.session_window("at", gap)).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"))
    return d.select("session_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "calls", "errors")


def finished(stream: DataFrame, mode: str, keys: list[str], keyed: bool = False) -> DataFrame:
    """Run over all that is there now and give the last row of each key; both sink and checkpoint stand in the shared folder.

    ``keyed``: the stream has processors of ``state``, which need their own state store.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    store, before = STORE[0], spark.conf.get(STORE[0], None)
    if keyed:
        spark.conf.set(*STORE)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(write).trigger(availableNow=True).start()
    finally:
        if keyed:
            spark.conf.set(store, before) if before else spark.conf.unset(store)
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out").drop("epoch")
    others = [c for c in out.columns if c not in (*keys, "_epoch")]
    return out.groupBy(*keys).agg(*[F.max_by(c, "_epoch").alias(c) for c in others])
