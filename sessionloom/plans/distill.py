"""Queries over distilled sessions."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import distill as o
from sessionloom.sources.bind import TRACE, trace

W = "(PARTITION BY session_id ORDER BY ts, id"
OUT = "coalesce(nullif(output, ''), content, '')"
GET = lambda *n: "coalesce(" + ", ".join(f"json_extract_string(j, '$.{x}')" for x in n) + ", '')"
SUMMARY = f"""CASE WHEN tool_name IN ('Read', 'read_file') THEN 'Read ' || {GET('file_path', 'path')} WHEN tool_name IN ('Write', 'write_file') THEN 'Write ' || {GET('file_path', 'path')}
 WHEN tool_name IN ('Edit', 'edit_file') THEN 'Edit ' || {GET('file_path', 'path')} WHEN tool_name = 'Bash' THEN 'Run: ' || CASE WHEN length({GET('command')}) > 120 THEN substr({GET('command')}, 1, 117) || '...' ELSE {GET('command')} END
 WHEN tool_name = 'Grep' THEN 'Search for ''' || {GET('pattern')} || ''' in ' || {GET('path')} WHEN tool_name = 'Glob' THEN 'Find files: ' || {GET('pattern')}
 WHEN starts_with(tool_name, 'mcp__') THEN 'MCP: ' || replace(replace(tool_name, 'mcp__', ''), '__', '.') ELSE tool_name END"""
JUDGED = f"""{TRACE}, u AS (SELECT *, coalesce(max(role = 'user' AND regexp_matches(lower(coalesce(content, '')), '{t.TAKEN_BACK}')) OVER {W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), false) AS un FROM t),
 c AS (SELECT *, coalesce(tool_input, '') AS a, lag(tool_name) OVER {W}) AS pt, coalesce(lag(coalesce(tool_input, '')) OVER {W}), '') AS b FROM u WHERE role = 'assistant' AND tool_name IS NOT NULL AND NOT un),
 g AS (SELECT *, CASE WHEN coalesce(error, '') <> '' OR length({OUT}) < 500 AND regexp_matches({OUT}, '(?i){t.FAILED}') THEN 'failed'
  WHEN pt = tool_name AND (a = b OR a <> '' AND b <> '' AND length(a) > 20 AND len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] = x[2]))::DOUBLE / greatest(length(a), length(b)) > 0.8) THEN 'retry' ELSE 'kept' END AS verdict FROM c)"""
STEPS = f"""{JUDGED}, k0 AS (SELECT *, CASE WHEN json_valid(tool_input) THEN tool_input END AS j FROM g WHERE verdict = 'kept'), k1 AS (SELECT *, {SUMMARY} AS summary FROM k0),
 k2 AS (SELECT *, coalesce(lag(summary) OVER {W}) = summary, false) AND tool_name IN ('Read', 'read_file') AS again FROM k1),
 k3 AS (SELECT *, CAST(row_number() OVER {W}) AS INTEGER) AS step_num, count(*) OVER (PARTITION BY session_id) AS total FROM k2 WHERE NOT again),
 p AS (SELECT *, CASE WHEN (step_num - 1)::DOUBLE / total < 0.3 THEN 'explore' WHEN (step_num - 1)::DOUBLE / total < 0.8 THEN 'implement' ELSE 'verify' END AS phase, CASE WHEN length({OUT}) > 200 THEN substr({OUT}, 1, 197) || '...' ELSE {OUT} END AS preview FROM k3)"""
# Two places by the exact binary value, half to even; round_even(x, 2) scales the double first, which moves ties (23 of 40).
EXACT = "CAST({} * 1152921504606846976.0::DOUBLE AS HUGEINT) * 100"
HUNDREDTHS = lambda x: "(({0} // 1152921504606846976) + CASE WHEN {0} % 1152921504606846976 > 576460752303423488 OR {0} % 1152921504606846976 = 576460752303423488 AND ({0} // 1152921504606846976) % 2 = 1 THEN 1 ELSE 0 END)::DOUBLE / 100".format(f"({EXACT.format(f'({x})')})")
STATS = f"""{STEPS}, s0 AS (SELECT session_id, count(*) AS total_messages, count(*) FILTER (WHERE role = 'assistant' AND tool_name IS NOT NULL) AS total_tool_calls,
  coalesce(substr(arg_min(trim(content), {{'t': ts, 'i': id}}) FILTER (WHERE role = 'user' AND tool_name IS NULL AND length(trim(content)) > 10), 1, 500), '') AS user_goal,
  coalesce(substr(arg_max(trim(content), {{'t': ts, 'i': id}}) FILTER (WHERE role = 'user' AND tool_name IS NULL AND length(trim(content)) > 3), 1, 300), '') AS final_outcome FROM t GROUP BY 1),
 s1 AS (SELECT session_id, count(*) FILTER (WHERE verdict = 'failed') AS failed_calls, count(*) FILTER (WHERE verdict = 'retry') AS retries FROM g GROUP BY 1), s2 AS (SELECT session_id, count(*) AS winning_steps FROM p GROUP BY 1),
 st AS (SELECT s0.*, coalesce(failed_calls, 0) AS failed_calls, coalesce(retries, 0) AS retries, coalesce(winning_steps, 0) AS winning_steps, {HUNDREDTHS('coalesce(winning_steps, 0)::DOUBLE / greatest(total_tool_calls, 1)')} AS compression_ratio
  FROM s0 LEFT JOIN s1 ON s1.session_id = s0.session_id LEFT JOIN s2 ON s2.session_id = s0.session_id)"""
NL = "chr(10)"
CMD = "CASE WHEN json_valid(substr(tool_input, 1, 500)) THEN json_extract_string(substr(tool_input, 1, 500), '$.command') END"

QUERIES = {
    "judged_calls": (
        lambda s, d: o.judged(trace(s, d)).select("id", "session_id", "verdict"),
        f"WITH {JUDGED} SELECT id, session_id, verdict FROM g",
    ),
    "distilled_steps": (
        lambda s, d: o.steps(trace(s, d)).select("session_id", "step_num", "id", "summary", "phase", "preview"),
        f"WITH {STEPS} SELECT session_id, step_num, id, summary, phase, preview FROM p",
    ),
    "distill_stats": (
        lambda s, d: o.stats(trace(s, d)),
        f"WITH {STATS} SELECT * FROM st",
    ),
    "playbooks": (
        lambda s, d: o.playbooks(trace(s, d)).select("session_id", F.md5("playbook").alias("playbook_md5"), F.length("playbook").alias("n_chars")),
        f"""WITH {STATS}, f AS (SELECT *, coalesce(lag(phase) OVER (PARTITION BY session_id ORDER BY step_num), '') <> phase AS fst, {CMD} AS cmd FROM p),
        b AS (SELECT session_id, string_agg(CASE WHEN fst THEN '## ' || CASE phase {' '.join(f"WHEN '{n}' THEN '{x}'" for n, x in o.LABELS)} END || {NL} || {NL} ELSE '' END || step_num || '. **' || summary || '**' || {NL}
          || CASE WHEN tool_name = 'Bash' AND length(cmd) > 0 AND length(cmd) < 200 THEN '   ```bash' || {NL} || '   ' || cmd || {NL} || '   ```' || {NL} ELSE '' END, {NL} ORDER BY step_num) AS body FROM f GROUP BY 1),
        x AS (SELECT st.session_id, rtrim('# Session Playbook' || {NL} || {NL} || CASE WHEN user_goal <> '' THEN '**Goal:** ' || CASE WHEN length(user_goal) > 200 THEN substr(user_goal, 1, 197) || '...' ELSE user_goal END || {NL} || {NL} ELSE '' END
          || '**Session Stats:** ' || total_tool_calls || ' tool calls → ' || winning_steps || ' winning steps (' || CAST(round_even(compression_ratio * 100, 0) AS INTEGER) || '% compression). Filtered out ' || failed_calls || ' failures, ' || retries || ' retries.' || {NL} || {NL}
          || coalesce(body || {NL}, '') || CASE WHEN final_outcome <> '' THEN '## Outcome' || {NL} || '> ' || final_outcome || {NL} ELSE '' END) AS t FROM st LEFT JOIN b ON b.session_id = st.session_id)
        SELECT session_id, md5(t) AS playbook_md5, CAST(length(t) AS INTEGER) AS n_chars FROM x""",
    ),
}
