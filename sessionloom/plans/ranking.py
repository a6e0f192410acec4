"""Queries over patterns."""

from sessionloom.operators import flows as f
from sessionloom.operators import ranking as r
from sessionloom.plans.flows import RUNS, SUMMARY, _events
from sessionloom.sources.bind import STREAM, table, tool_stream

AS_OF = "2024-02-20 00:00:00"
AGE = "(date_diff('microsecond', {}, TIMESTAMP '2024-02-20') / 8.64e10)"
P = f"{STREAM}, p AS (SELECT session_id % 50 AS grp, tool, count(*) AS error_count, count(DISTINCT session_id) AS session_count, min(ts) AS first_seen, max(ts) AS last_seen FROM s GROUP BY 1, 2)"
L = AGE.format("last_seen")
DECAY = f"(CASE WHEN last_seen IS NULL THEN 0.3::DOUBLE WHEN {L} <= 14 THEN 1.0::DOUBLE WHEN {L} <= 28 THEN 1 - 0.4 * ({L} - 14) / 14 WHEN {L} <= 56 THEN 0.6 - 0.3 * ({L} - 28) / 28 ELSE 0.3 END)"
GRADE = f"CASE WHEN {DECAY} < 0.5 THEN 'declining' WHEN error_count >= 5 AND {AGE.format('first_seen')} >= 7 THEN 'established' WHEN error_count >= 3 AND session_count >= 3 THEN 'strong' WHEN error_count >= 2 AND session_count >= 2 THEN 'emerging' END"


def _patterns(s, d):
    return r.patterns(tool_stream(s, d).selectExpr("*", "session_id % 50 AS grp"), ["grp", "tool"])


QUERIES = {
    "rank_score": (
        lambda s, d: r.rank_score(_patterns(s, d), AS_OF).select("grp", "tool", "rank_score"),
        f"WITH {P} SELECT grp, tool, round(error_count / (1 + greatest({L}, 0)), 6) AS rank_score FROM p",
    ),
    "decay_confidence": (
        lambda s, d: r.confidence(r.rank_score(_patterns(s, d), AS_OF), AS_OF).select("grp", "tool", "confidence"),
        f"""WITH {P}, q AS (SELECT *, round(error_count / (1 + greatest({L}, 0)), 6) AS rs FROM p) SELECT grp, tool, round(greatest(0, least(1, (0.4::DOUBLE * least(error_count / 30.0::DOUBLE, 1)
        + 0.3::DOUBLE * least(ln(1.0::DOUBLE + error_count) / ln(91.0::DOUBLE), 1) + 0.3::DOUBLE * greatest(0, least(rs, 1))) * {DECAY})), 6) AS confidence FROM q""",
    ),
    "lifecycle_grade": (
        lambda s, d: r.live_grade(r.grade(_patterns(s, d), AS_OF), AS_OF).select("grp", "tool", "grade", "live_grade", "changed"),
        f"WITH {P}, q AS (SELECT *, {GRADE} AS grade, CASE WHEN {L} > 30 THEN 'dead' WHEN {L} > 7 THEN 'declining' ELSE 'established' END AS live_grade FROM p) SELECT grp, tool, grade, live_grade, live_grade IS DISTINCT FROM grade AS changed FROM q",
    ),
    "micro_patterns": (
        lambda s, d: r.micro_patterns(tool_stream(s, d)),
        f"""WITH {STREAM}, a AS (SELECT session_id, k, tool, count(*) AS n FROM s GROUP BY 1, 2, 3), b AS (SELECT *, sum(n) OVER (PARTITION BY session_id) AS total FROM a),
        c AS (SELECT session_id, k, tool, n, round(least(1.0::DOUBLE, n::DOUBLE / total + 0.1::DOUBLE * (n - 1)), 6) AS confidence FROM b WHERE n >= 2) SELECT *, count(*) OVER (PARTITION BY k, tool) AS sessions FROM c""",
    ),
    "recency_weight": (
        lambda s, d: r.recency_weights(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "weight"),
        "SELECT o_orderkey, round(CASE WHEN count(*) OVER w > 1 THEN 0.5::DOUBLE + 0.5::DOUBLE * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) / (count(*) OVER w - 1) ELSE 1.0 END, 6) AS weight FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    ),
    "quality_gates": (
        lambda s, d: r.quality_gates(tool_stream(s, d), "k"),
        f"WITH {STREAM}, a AS (SELECT k, count(*) AS examples, count(*) FILTER (WHERE is_error) AS failures, count(DISTINCT session_id) FILTER (WHERE is_error) AS failing_sessions FROM s GROUP BY 1) SELECT *, CASE WHEN examples < 10 THEN 'examples' WHEN failures < 5 THEN 'failures' WHEN failing_sessions < 3 THEN 'sessions' ELSE 'passed' END AS gate FROM a",
    ),
    "skill_candidates": (
        lambda s, d: r.skill_candidates(tool_stream(s, d), f.summary(_events(s, d))),
        f"""{RUNS}, {SUMMARY}, n AS (SELECT rtrim(x, '+') AS tool, flow_hash FROM (SELECT flow_hash, unnest(string_split(sequence, ' → ')) AS x FROM t)), fl AS (SELECT tool, count(DISTINCT flow_hash) AS flows FROM n GROUP BY 1),
        ta AS (SELECT tool, count(*) AS n, count(DISTINCT session_id) AS sessions, avg(CASE WHEN is_error THEN 0.0::DOUBLE ELSE 1.0 END) AS rate FROM s GROUP BY 1),
        b AS (SELECT ta.*, coalesce(flows, 0) AS flows, round(least(n / 20, 0.4::DOUBLE) + least(sessions / 10, 0.3::DOUBLE) + least(rate * 0.3::DOUBLE, 0.3::DOUBLE), 3) AS confidence FROM ta LEFT JOIN fl USING (tool))
        SELECT tool, n, sessions, round(rate, 6) AS rate, flows, confidence, CASE WHEN flows > 0 THEN 'workflow' ELSE 'tool' END AS kind, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS priority FROM b""",
    ),
}
