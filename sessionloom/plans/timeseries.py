"""Queries over time."""

from pyspark.sql import functions as F

from sessionloom.operators import timeseries as o
from sessionloom.plans.flows import RUNS, _events
from sessionloom.sources.bind import STREAM, tool_stream

W = "(PARTITION BY session_id ORDER BY ts, id)"


def rules():
    return F.array(F.concat(F.lit("a"), F.col("k") % 7), F.concat(F.lit("b"), F.col("k") % 5))


RULES_SQL = "SELECT *, unnest(['a' || (k % 7), 'b' || (k % 5)]) AS rule FROM s"

LAST, TOP = 5, 3


def _trend(s, d, unit):
    """Columns by age, b1 being the newest bucket, so that their names don't depend on the data."""
    wide, names = o.trend_table(tool_stream(s, d), "tool", unit, LAST, TOP)
    by_age = [F.col(f"`{names[-k]}`") if k <= len(names) else F.lit(0).cast("long") for k in range(1, LAST + 1)]
    return wide.select("rank", "tool", *[c.alias(f"b{k}") for k, c in enumerate(by_age, 1)], "total", "delta", "arrow")


def _trend_sql(form):
    columns = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE place = {k}), 0) AS BIGINT) AS b{k}" for k in range(1, LAST + 1))
    return f"""WITH {STREAM}, a AS (SELECT tool, strftime(ts, '{form}') AS bucket, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT bucket, row_number() OVER (ORDER BY bucket DESC) AS place FROM (SELECT DISTINCT bucket FROM a)),
        p AS (SELECT tool, {columns}, CAST(sum(n) AS BIGINT) AS total FROM a JOIN k USING (bucket) WHERE place <= {LAST} GROUP BY 1), r AS (SELECT *, CASE WHEN (SELECT count(*) FROM k) > 1 THEN b1 - b2 END AS delta, CAST(row_number() OVER (ORDER BY total DESC, tool) AS INTEGER) AS rank FROM p)
        SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' WHEN delta = 0 THEN 'flat' END AS arrow FROM r WHERE rank <= {TOP}"""


QUERIES = {
    "velocity_weekly_share": (
        lambda s, d: o.error_share(tool_stream(s, d)),
        f"WITH {STREAM}, a AS (SELECT date_trunc('week', ts)::TIMESTAMP AS window, tool, count(*) AS n FROM s GROUP BY 1, 2) SELECT \"window\", tool, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY \"window\"), 6) AS error_share FROM a",
    ),
    "adaptation_speed": (
        lambda s, d: o.adaptation_speed(tool_stream(s, d), "2024-01-15 00:00:00"),
        f"""WITH {STREAM}, p AS (SELECT avg(CAST(is_error AS INTEGER)) AS pre FROM s WHERE ts < TIMESTAMP '2024-01-15'), a AS (SELECT session_id, min(ts) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS f, sum(CAST(is_error AS INTEGER)) AS e, count(*) AS n FROM s GROUP BY 1),
        r AS (SELECT row_number() OVER w AS rk, sum(e) OVER w / sum(n) OVER w AS rate FROM a WHERE f IS NOT NULL WINDOW w AS (ORDER BY f, session_id)) SELECT CAST(coalesce(min(CASE WHEN rate <= pre / 2 THEN rk END), max(rk)) AS BIGINT) AS sessions, round(max(pre), 6) AS pre_share FROM r, p""",
    ),
    "rule_with_without": (
        lambda s, d: o.rule_rates(tool_stream(s, d), rules()),
        f"""WITH {STREAM}, x AS ({RULES_SQL}), r AS (SELECT rule, count(*) AS wn FROM x GROUP BY 1), b AS (SELECT rule, tool, count(*) AS wt FROM x GROUP BY 1, 2), t AS (SELECT tool, count(*) AS tn FROM s GROUP BY 1),
        j AS (SELECT rule, tool, wn, wt::DOUBLE / wn AS a, (tn - wt)::DOUBLE / nullif((SELECT count(*) FROM s) - wn, 0) AS o FROM r JOIN b USING (rule) JOIN t USING (tool) WHERE wn >= 50)
        SELECT rule, tool, wn AS with_n, round(a, 6) AS rate_with, round(o, 6) AS rate_without, round(100 * (a - o) / nullif(o, 0), 4) AS delta_pct FROM j""",
    ),
    "rule_outcomes": (
        lambda s, d: o.rule_outcomes(tool_stream(s, d), F.array(F.concat(F.lit("r"), F.col("k")))),
        f"""WITH {STREAM}, r AS (SELECT 'r' || k AS rule, min(ts) AS t0 FROM s WHERE k IS NOT NULL GROUP BY 1), j AS (SELECT rule, tool, count(*) FILTER (WHERE ts < t0) AS before, count(*) FILTER (WHERE ts >= t0) AS after FROM s JOIN r ON ts >= t0 - INTERVAL 5 DAY AND ts <= t0 + INTERVAL 5 DAY GROUP BY 1, 2),
        d AS (SELECT *, round(100.0::DOUBLE * (after - before) / nullif(before, 0), 4) AS delta_pct FROM j)
        SELECT *, CASE WHEN before + after >= 100 THEN 'high' WHEN before + after >= 25 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN delta_pct <= -20 THEN 'keep' WHEN delta_pct >= 10 THEN 'review' ELSE 'watch' END AS advice FROM d""",
    ),
    "even_sample": (
        lambda s, d: o.even_sample(tool_stream(s, d)).select("id", "tool"),
        f"WITH {STREAM}, i AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts, id) - 1 AS i, greatest(floor(count(*) OVER (PARTITION BY tool) / 5), 1) AS st FROM s) SELECT id, tool FROM i WHERE i % st = 0 AND i / st < 5",
    ),
    "cohort_error_delta": (
        lambda s, d: o.cohort_delta(tool_stream(s, d), "2024-01-10 00:00:00", "2024-01-13 12:00:00"),
        f"""WITH {STREAM}, a AS (SELECT tool, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-13 12:00:00') AS n, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10') AS base_n
        FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-13 12:00:00' GROUP BY 1) SELECT tool, n, base_n, round(n / 84.0::DOUBLE, 4) AS per_hour, round(base_n / 168.0::DOUBLE, 4) AS base_per_hour, round(100 * (n / 84.0::DOUBLE - base_n / 168.0::DOUBLE) / nullif(base_n / 168.0::DOUBLE, 0), 1) AS delta_pct FROM a""",
    ),
    "new_error_classes": (
        lambda s, d: o.new_classes(tool_stream(s, d).withColumn("class", F.concat_ws(":", "tool", "session_id", (F.col("k") % 9).cast("string"))), "class", "2024-01-20 00:00:00"),
        f"WITH {STREAM}, c AS (SELECT *, concat_ws(':', tool, session_id, k % 9) AS class FROM s) SELECT class, count(*) AS n, min(id) AS sample FROM c WHERE ts >= TIMESTAMP '2024-01-20' AND class NOT IN (SELECT class FROM c WHERE ts < TIMESTAMP '2024-01-20') GROUP BY 1",
    ),
    "flow_emerged_died": (
        lambda s, d: o.emerged_and_died(_events(s, d), "2024-01-16 00:00:00"),
        f"{RUNS} SELECT sequence, CASE WHEN max(ts >= TIMESTAMP '2024-01-16') THEN 'emerged' ELSE 'died' END AS change FROM e GROUP BY 1 HAVING max(ts < TIMESTAMP '2024-01-16') <> max(ts >= TIMESTAMP '2024-01-16')",
    ),
    "mad_anomalies": (
        lambda s, d: o.mad_anomalies(tool_stream(s, d).groupBy("session_id").agg(F.round(F.sum("amount"), 4).alias("amount")), "session_id", "amount"),
        f"""WITH {STREAM}, a AS (SELECT session_id, round(sum(amount), 4) AS amount FROM s GROUP BY 1), m AS (SELECT median(amount) AS median FROM a), o AS (SELECT *, abs(amount - median) AS off FROM a, m), x AS (SELECT median(off) AS mad FROM o)
        SELECT session_id, round(amount, 6) AS amount, round(median, 6) AS median, round(mad, 6) AS mad FROM o, x WHERE CASE WHEN mad = 0 THEN off > 0 ELSE off / mad > 3 END AND (SELECT count(*) FROM a) >= 3""",
    ),
    "trend_pivot_week": (
        lambda s, d: o.weekly_trend(tool_stream(s, d)),
        f"WITH {STREAM}, a AS (SELECT tool, strftime(ts, '%Y-W%W') AS week, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT *, lag(n) OVER (PARTITION BY tool ORDER BY week) AS previous FROM a) SELECT *, CASE WHEN n > previous THEN 'up' WHEN n < previous THEN 'down' ELSE 'flat' END AS arrow FROM b",
    ),
    **{f"trend_table_{unit}": (lambda s, d, unit=unit: _trend(s, d, unit), _trend_sql(form)) for unit, form in (("day", "%Y-%m-%d"), ("week", "%Y-W%W"), ("month", "%Y-%m"))},
    "daily_trend_dense": (
        lambda s, d: o.dense_daily(tool_stream(s, d)).withColumn("day", F.col("day").cast("string")),
        f"WITH {STREAM}, a AS (SELECT tool, ts::DATE AS day, count(*) AS n FROM s GROUP BY 1, 2), g AS (SELECT DISTINCT tool FROM a), r AS (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM a) SELECT g.tool, CAST(r.day AS VARCHAR) AS day, coalesce(a.n, 0) AS n FROM g CROSS JOIN r LEFT JOIN a ON a.tool = g.tool AND a.day = r.day",
    ),
    "active_time_rapid_repeat": (
        lambda s, d: o.active_time(tool_stream(s, d), 720, 900),
        f"""WITH {STREAM}, i AS (SELECT *, date_diff('microsecond', lag(ts) OVER {W}, ts) / 6e7 AS gap, lag(tool) OVER {W} = tool AS same FROM s),
        a AS (SELECT session_id, count(*) AS n, round(coalesce(sum(gap) FILTER (WHERE gap <= 720), 0), 4) AS active_min, count(*) FILTER (WHERE same AND gap <= 900) AS rapid, count(*) FILTER (WHERE is_error) AS errors FROM i GROUP BY 1)
        SELECT *, CASE WHEN errors >= 0.25 * n THEN 'bypass' WHEN rapid >= 0.5 * n THEN 'trial' ELSE 'friction' END AS label FROM a WHERE n >= 4""",
    ),
    "signature_lifecycle": (
        lambda s, d: o.lifecycle(tool_stream(s, d).withColumn("signature", F.concat_ws("-", "tool", F.col("k").cast("string"))), "signature", "2024-02-01 00:00:00").withColumn("peak_day", F.col("peak_day").cast("string")),
        f"""WITH {STREAM}, c AS (SELECT *, concat_ws('-', tool, k) AS signature FROM s), y AS (SELECT signature, ts::DATE AS day, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM c GROUP BY 1, 2),
        a AS (SELECT signature, CAST(sum(n) AS BIGINT) AS total, min(lo) AS first, max(hi) AS last, CAST(arg_min(day, {{'n': -n, 'd': day}}) AS VARCHAR) AS peak_day FROM y GROUP BY 1),
        b AS (SELECT *, CAST(floor(floor(date_diff('microsecond', last, TIMESTAMP '2024-02-01') / 1e6) / 86400) AS BIGINT) AS idle_days FROM a) SELECT *, CASE WHEN total < 5 THEN 'minor' WHEN idle_days < 3 THEN 'active' ELSE 'dormant' END AS state FROM b""",
    ),
    "rolling_24h_spend": (
        lambda s, d: o.rolling_spend(tool_stream(s, d), 100.0).select("id", "spend", "over_cap"),
        f"WITH {STREAM}, a AS (SELECT id, round(sum(amount) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS spend FROM s) SELECT *, spend > 100 AS over_cap FROM a",
    ),
}
