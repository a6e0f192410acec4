"""Queries over flows."""

from sessionloom.operators import flows as f
from sessionloom.sources.bind import STREAM, tool_stream


def _events(spark, sf_dir):
    return f.first_per_session(f.ngrams(f.runs(f.praise(tool_stream(spark, sf_dir), "purchase"))))


RUNS = f"""WITH {STREAM},
p AS (SELECT *, coalesce(max(tool = 'purchase') OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS praised FROM s),
q AS (SELECT * FROM p WHERE tool <> 'purchase'),
i AS (SELECT *, CASE WHEN coalesce(lag(tool) OVER w, '') <> tool THEN 1 ELSE 0 END AS fresh FROM q WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, id) AS run FROM i),
r AS (SELECT session_id, run, CASE WHEN count(*) > 1 THEN min(tool) || '+' ELSE min(tool) END AS key, min(ts) AS ts, max(CAST(praised AS INTEGER)) AS praised FROM j GROUP BY 1, 2),
g AS (SELECT session_id, run, ts, n AS size, list(key) OVER w AS ks, list(praised) OVER w AS gs FROM r, (SELECT unnest([2, 3, 4, 5]) AS n) WINDOW w AS (PARTITION BY session_id, n ORDER BY run ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
h AS (SELECT session_id, run, ts, size, array_to_string(ks[1:size], ' → ') AS sequence, list_max(gs[1:size]) AS success FROM g WHERE len(ks) >= size),
e AS (SELECT * FROM (SELECT *, substr(sha256(sequence), 1, 16) AS flow_hash, row_number() OVER (PARTITION BY session_id, sequence ORDER BY size, run) AS rn FROM h) WHERE rn = 1)"""
SUMMARY = """a AS (SELECT flow_hash, sequence, count(*) AS total, CAST(sum(success) AS BIGINT) AS successes, count(DISTINCT session_id) AS sessions, max(ts) AS last_seen FROM e GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT *, round(100.0::DOUBLE * successes / total, 1) AS success_rate FROM a)"""

QUERIES = {
    "flow_ngrams_top": (
        lambda s, d: f.summary(_events(s, d)),
        f"{RUNS}, {SUMMARY} SELECT *, CASE WHEN total >= 20 AND success_rate >= 40 THEN 'HIGH' WHEN total >= 10 AND success_rate >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM t",
    ),
    "flow_promotable": (
        lambda s, d: f.promotable(_events(s, d)),
        f"{RUNS} SELECT flow_hash, sequence, count(DISTINCT session_id) AS sessions, round(avg(CAST(success AS DOUBLE)), 4) AS rate FROM e GROUP BY 1, 2 HAVING count(DISTINCT session_id) >= 5 AND avg(CAST(success AS DOUBLE)) > 0.7",
    ),
    "flow_twins": (
        lambda s, d: f.twins(_events(s, d)),
        f"{RUNS} SELECT flow_hash, CAST(sum(success) AS BIGINT) AS successes, CAST(sum(1 - success) AS BIGINT) AS failures FROM e GROUP BY 1 HAVING sum(success) >= 3 AND sum(1 - success) >= 3",
    ),
    "flow_next_tool_pairs": (
        lambda s, d: f.next_tools(f.summary(_events(s, d))),
        f"{RUNS}, {SUMMARY}, x AS (SELECT flow_hash, total, string_split(sequence, ' → ') AS p FROM t WHERE total >= 5), y AS (SELECT *, unnest(range(1, len(p))) AS cut FROM x) SELECT flow_hash, CAST(cut AS INTEGER) AS cut, array_to_string(p[1:cut], ' → ') AS prefix, p[cut + 1] AS next_tool, total FROM y",
    ),
    "flow_paired_samples": (
        lambda s, d: f.paired_samples(_events(s, d)).select("flow_hash", "success", "session_id"),
        f"{RUNS} SELECT flow_hash, success, session_id FROM (SELECT *, row_number() OVER (PARTITION BY flow_hash, success ORDER BY md5('7|' || flow_hash || '|' || session_id), session_id) AS k FROM e) WHERE k <= 2",
    ),
    "rle_runs": (
        lambda s, d: f.runs(tool_stream(s, d)).select("session_id", "run", "key", "n", "ts"),
        f"""WITH {STREAM}, i AS (SELECT *, CASE WHEN coalesce(lag(tool) OVER (PARTITION BY session_id ORDER BY ts, id), '') <> tool THEN 1 ELSE 0 END AS fresh FROM s),
        j AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, id) AS run FROM i)
        SELECT session_id, CAST(run AS BIGINT) AS run, CASE WHEN count(*) > 1 THEN min(tool) || '+' ELSE min(tool) END AS key, count(*) AS n, min(ts) AS ts FROM j GROUP BY 1, 2""",
    ),
    "flow_success_segments": (
        lambda s, d: f.praise(tool_stream(s, d), "purchase").select("id", "session_id", "tool", "praised"),
        f"WITH {STREAM}, p AS (SELECT *, coalesce(max(tool = 'purchase') OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS praised FROM s) SELECT id, session_id, tool, praised FROM p WHERE tool <> 'purchase'",
    ),
}
