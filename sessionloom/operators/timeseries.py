"""Rates over windows, cohorts, rule outcomes, anomalies and trends.

Every operator takes its bounds or ``as_of`` as literals: none asks the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_time() -> WindowSpec:
    """Rows of a session in order of time."""
    return Window.partitionBy("session_id").orderBy("ts", "id")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole), digits)


def error_share(stream: DataFrame, unit: str = "WEEK") -> DataFrame:
    """Each type's share of all rows of its window."""
    d = stream.groupBy(F.date_trunc(unit, "ts").alias("window"), "tool").agg(F.count("*").alias("n"))
    return d.withColumn("error_share", share(F.col("n"), F.sum("n").over(Window.partitionBy("window"))))


def adaptation_speed(stream: DataFrame, change: str, tool: str = "error") -> DataFrame:
    """T4: sessions after a change until the cumulative share of ``tool`` is half of that before; else all.

    Sessions come in the order of their first row after the change; their counts are of all their rows.
    """
    at = F.to_timestamp_ntz(F.lit(change))
    hit = (F.col("tool") == tool).cast("long")
    before = stream.where(F.col("ts") < at).agg(F.avg(hit.cast("double")).alias("pre"))
    s = stream.groupBy("session_id").agg(F.min(F.when(F.col("ts") >= at, F.col("ts"))).alias("first"), F.sum(hit).alias("e"), F.count("*").alias("n")).where("first is not null")
    # Prefix sums hour by hour, then within the hour: only one row an hour is in one window.
    s = s.withColumn("hour", F.date_trunc("hour", "first"))
    hours = s.groupBy("hour").agg(F.count("*").alias("c"), F.sum("e").alias("he"), F.sum("n").alias("hn"))
    past = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    base = hours.select("hour", *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in ("c", "he", "hn")])
    w = Window.partitionBy("hour").orderBy("first", "session_id")
    s = s.join(base, "hour").select((F.col("c") + F.row_number().over(w)).alias("rank"), ((F.col("he") + F.sum("e").over(w)) / (F.col("hn") + F.sum("n").over(w))).alias("rate"))
    s = s.crossJoin(F.broadcast(before))  # one row
    return s.agg(F.coalesce(F.min(F.when(F.col("rate") <= F.col("pre") / 2, F.col("rank"))), F.max("rank")).cast("long").alias("sessions"), F.round(F.max("pre"), 6).alias("pre_share"))


def rule_rates(stream: DataFrame, rules: Column, least: int = 50) -> DataFrame:
    """Per rule and type the share of rows with the rule and without; the totals give the second by subtraction."""
    d = stream.withColumn("rule", F.explode(rules))
    by_type = stream.groupBy("tool").agg(F.count("*").alias("all_t"))
    total = stream.agg(F.count("*").alias("all_n"))
    per_rule = d.groupBy("rule").agg(F.count("*").alias("with_n"))
    per_both = d.groupBy("rule", "tool").agg(F.count("*").alias("with_t"))
    out = per_rule.crossJoin(F.broadcast(total)).join(per_both, "rule").join(by_type, "tool").where(F.col("with_n") >= least)
    a, b = F.col("with_t") / F.col("with_n"), F.try_divide(F.col("all_t") - F.col("with_t"), F.col("all_n") - F.col("with_n"))
    return out.select("rule", "tool", "with_n", F.round(a, 6).alias("rate_with"), F.round(b, 6).alias("rate_without"), F.round(100 * F.try_divide(a - b, b), 4).alias("delta_pct"))


def rule_outcomes(stream: DataFrame, rules: Column, days: int = 5) -> DataFrame:
    """Rows of each type in the window before a rule was first seen and from then on; change, tier and advice.

    Days are the equal key of the range join; the exact bounds are its residual.
    """
    seen = stream.withColumn("rule", F.explode(rules)).groupBy("rule").agg(F.min("ts").alias("t0"))
    span = F.expr(f"INTERVAL {days} DAYS")
    days_of = seen.withColumn("_day", F.explode(F.sequence(F.to_date(F.col("t0") - span), F.to_date(F.col("t0") + span))))
    hits = stream.select("ts", "tool", F.to_date("ts").alias("_day")).join(days_of, "_day").where((F.col("ts") >= F.col("t0") - span) & (F.col("ts") <= F.col("t0") + span))
    d = hits.groupBy("rule", "tool").agg(F.count_if(F.col("ts") < F.col("t0")).alias("before"), F.count_if(F.col("ts") >= F.col("t0")).alias("after"))
    d = d.withColumn("delta_pct", F.round(100.0 * F.try_divide(F.col("after") - F.col("before"), F.col("before")), 4))
    n = F.col("before") + F.col("after")
    tier = F.when(n >= 100, "high").when(n >= 25, "medium").otherwise("low")
    advice = F.when(F.col("delta_pct") <= -20, "keep").when(F.col("delta_pct") >= 10, "review").otherwise("watch")
    return d.withColumn("tier", tier).withColumn("advice", advice)


def even_sample(stream: DataFrame, n: int = 5) -> DataFrame:
    """Every floor(count/n)-th row of each type in order of time, n at most."""
    w = Window.partitionBy("tool")
    d = stream.withColumn("_i", F.row_number().over(w.orderBy("ts", "id")) - 1).withColumn("_step", F.greatest(F.floor(F.count("*").over(w) / n), F.lit(1)))
    return d.where((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < n)).drop("_i", "_step")


def cohort_delta(stream: DataFrame, start: str, end: str, baseline_days: int = 7) -> DataFrame:
    """Rows per hour of each type in a cohort window and in its baseline; both ends belong to both."""
    a, b = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    base = a - F.expr(f"INTERVAL {baseline_days} DAYS")
    hours = F.timestamp_diff("MICROSECOND", a, b) / 3.6e9
    d = stream.where((F.col("ts") >= base) & (F.col("ts") <= b)).groupBy("tool").agg(F.count_if(F.col("ts").between(a, b)).alias("n"), F.count_if(F.col("ts").between(base, a)).alias("base_n"))
    now, then = F.col("n") / hours, F.col("base_n") / F.lit(baseline_days * 24.0)
    return d.select("tool", "n", "base_n", F.round(now, 4).alias("per_hour"), F.round(then, 4).alias("base_per_hour"), F.round(100 * F.try_divide(now - then, then), 1).alias("delta_pct"))


def new_classes(stream: DataFrame, key: str, start: str) -> DataFrame:
    """Classes after ``start`` that were not there before, with their number and first sample."""
    at = F.to_timestamp_ntz(F.lit(start))
    late = stream.where(F.col("ts") >= at).groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("sample"))
    return late.join(stream.where(F.col("ts") < at).select(key).distinct(), key, "left_anti")


def emerged_and_died(flow_rows: DataFrame, at: str) -> DataFrame:
    """Flows seen only since ``at``, or only before, in one aggregation."""
    d = flow_rows.groupBy("sequence").agg(F.max(F.col("ts") < F.to_timestamp_ntz(F.lit(at))).alias("was"), F.max(F.col("ts") >= F.to_timestamp_ntz(F.lit(at))).alias("is"))
    return d.where("was <> is").select("sequence", F.when(F.col("is"), "emerged").otherwise("died").alias("change"))


#: So many values one aggregation may hold.
FEW = 1_000_000


def exact_median(values: DataFrame, value: str, name: str, few: bool = False, accuracy: int = 1_000_000) -> DataFrame:
    """One row (name, rows): the exact median and the number of values.

    ``few`` says that there are FEW values at most, which one aggregation holds.  Else two approximate percentiles
    close about the half bound where it lies, and only the values between them are put in order.
    """
    if few:
        return values.agg(F.percentile(value, F.lit(0.5)).alias(name), F.count(value).alias("rows"))
    near = F.percentile_approx(value, F.array(F.lit(0.5 - 10 / accuracy), F.lit(0.5 + 10 / accuracy)), accuracy)
    ends = values.agg(near.alias("_near"), F.count(value).alias("rows"))
    d = values.select(F.col(value).alias("_x")).crossJoin(F.broadcast(ends)).where("_x is not null")
    counts = d.where(F.col("_x") <= F.col("_near")[1]).groupBy(F.greatest("_x", F.col("_near")[0]).alias("_v"), (F.col("_x") < F.col("_near")[0]).alias("_low")).agg(F.count("*").alias("_n"), F.first("rows").alias("rows"))
    upto = F.sum("_n").over(Window.orderBy(F.col("_low").desc(), "_v"))
    ranked = counts.withColumn("_upto", upto).where("not _low")
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    return ranked.agg(((at(F.floor((F.col("rows") - 1) / 2)) + at(F.floor(F.col("rows") / 2))) / 2).alias(name), F.first("rows").alias("rows"))


def mad_anomalies(values: DataFrame, key: str, value: str, limit: float = 3.0) -> DataFrame:
    """|x - median| / MAD over the limit, unscaled; with MAD zero any other value; nothing under three rows."""
    few = values.count() <= FEW
    m = exact_median(values, value, "median", few)  # one row, like the next
    d = values.crossJoin(F.broadcast(m)).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = exact_median(d.select("off"), "off", "mad", few).select("mad")
    d = d.crossJoin(F.broadcast(mad))
    odd = F.when(F.col("mad") == 0, F.col("off") > 0).otherwise(F.col("off") / F.col("mad") > limit)
    return d.where(odd & (F.col("rows") >= 3)).select(key, F.round(value, 6).alias(value), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def week_of(ts: Column) -> Column:
    """Year and week of the year, weeks beginning on Monday, days before the first one in week 00."""
    w = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(w.cast("string"), 2, "0"))


def weekly_trend(stream: DataFrame) -> DataFrame:
    """Counts by type and week, the week before, and an arrow."""
    d = stream.groupBy("tool", week_of(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    d = d.withColumn("previous", F.lag("n").over(Window.partitionBy("tool").orderBy("week")))
    return d.withColumn("arrow", F.when(F.col("n") > F.col("previous"), "up").when(F.col("n") < F.col("previous"), "down").otherwise("flat"))


#: How a time is named by its day, week or month.
BUCKETS: dict[str, Callable[[Column], Column]] = {"day": lambda ts: F.date_format(ts, "yyyy-MM-dd"), "week": week_of, "month": lambda ts: F.date_format(ts, "yyyy-MM")}


def trend_table(stream: DataFrame, key: str, unit: str, last: int, top: int) -> tuple[DataFrame, list[str]]:
    """The ``top`` keys by rows in the last ``last`` buckets that occur, a column for each bucket, oldest first; and the buckets.

    (rank, key, buckets, total, delta, arrow): the newest bucket against the one before; both null with fewer than two.
    Only the names of the buckets come to the driver.
    """
    counts = stream.groupBy(key, BUCKETS[unit](F.col("ts")).alias("bucket")).agg(F.count("*").alias("n")).where("bucket is not null")
    names = sorted(r["bucket"] for r in counts.select("bucket").distinct().orderBy(F.col("bucket").desc()).limit(last).collect())
    wide = counts.groupBy(key).pivot("bucket", names).agg(F.sum("n")) if names else counts.groupBy(key).agg(F.count("*").alias("_none"))
    wide = wide.select(key, *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).alias(b) for b in names])
    total = F.lit(0).cast("long")
    for b in names:
        total = total + F.col(f"`{b}`")
    delta = F.col(f"`{names[-1]}`") - F.col(f"`{names[-2]}`") if len(names) > 1 else F.lit(None).cast("long")
    d = wide.withColumn("total", total).where("total > 0").withColumn("delta", delta)
    d = d.withColumn("arrow", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "flat"))
    first = d.orderBy(F.col("total").desc(), key).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), key))), names


def dense_daily(stream: DataFrame) -> DataFrame:
    """Counts on the whole grid of types and days, missing ones 0."""
    d = stream.groupBy("tool", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    grid = d.select("tool").distinct().crossJoin(F.broadcast(d.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))))
    return grid.join(d, ["tool", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def active_time(stream: DataFrame, active_min: int, rapid_min: int) -> DataFrame:
    """Per session the sum of short gaps, rapid repeats of one tool, and a label."""
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(by_time()), F.col("ts")) / 6e7
    d = stream.withColumn("_gap", gap).withColumn("_same", F.lag("tool").over(by_time()) == F.col("tool"))
    d = d.groupBy("session_id").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("_gap") <= active_min, F.col("_gap"))), F.lit(0.0)), 4).alias("active_min"),
        F.count_if(F.col("_same") & (F.col("_gap") <= rapid_min)).alias("rapid"), F.count_if("is_error").alias("errors"),
    )
    label = F.when(F.col("errors") >= 0.25 * F.col("n"), "bypass").when(F.col("rapid") >= 0.5 * F.col("n"), "trial").otherwise("friction")
    return d.where("n >= 4").withColumn("label", label)


def lifecycle(stream: DataFrame, key: str, as_of: str, idle_days: int = 3) -> DataFrame:
    """Total, first, last and busiest day of each signature, idle days and state."""
    day = stream.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    d = day.groupBy(key).agg(F.sum("n").alias("total"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.min_by("day", F.struct((-F.col("n")).alias("n"), "day")).alias("peak_day"))
    idle = F.floor(F.timestamp_diff("SECOND", F.col("last"), F.to_timestamp_ntz(F.lit(as_of))) / 86400)
    state = F.when(F.col("total") < 5, "minor").when(F.col("idle_days") < idle_days, "active").otherwise("dormant")
    return d.withColumn("idle_days", idle.cast("long")).withColumn("state", state)


def rolling_spend(stream: DataFrame, cap: float) -> DataFrame:
    """K9: spend of the 24 hours up to each row of a session, and whether it is over the cap."""
    hours = stream.withColumn("_us", F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")))
    w = Window.partitionBy("session_id").orderBy("_us").rangeBetween(-86_400_000_000, 0)
    return hours.withColumn("spend", F.round(F.sum("amount").over(w), 4)).withColumn("over_cap", F.col("spend") > cap).drop("_us")
