"""Queries over rule files."""

from pyspark.sql import functions as F

from sessionloom.operators import mining
from sessionloom.operators import rules as o
from sessionloom.plans.mining import ERRORS
from sessionloom.sources.bind import RULE_FILES, rule_files, trace

STOPS = "[" + ", ".join(f"'{w}'" for w in o.STOP_WORDS) + "]"
PARSED = rf"""{RULE_FILES}, l AS (SELECT path, unnest(a) AS line, generate_subscripts(a, 1) AS line_number FROM (SELECT path, regexp_split_to_array(text, '\r?\n') AS a FROM f)),
 l1 AS (SELECT *, starts_with(ltrim(line), '```') AS fence FROM l), l2 AS (SELECT *, sum(fence::INTEGER) OVER (PARTITION BY path ORDER BY line_number) % 2 AS op FROM l1),
 l3 AS (SELECT path, CAST(line_number AS INTEGER) AS line_number, trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[-*]\s+', ''), '^\d+\.\s+', ''), '\*{{1,2}}(.+?)\*{{1,2}}', '\1', 'g')) AS rule
   FROM l2 WHERE op = 0 AND NOT fence AND NOT regexp_matches(line, '{o.PASSED_OVER}') AND regexp_matches(line, '{o.IMPERATIVE}')), r AS (SELECT * FROM l3 WHERE rule <> '')"""
TERMS = rf"""{PARSED}, q AS (SELECT DISTINCT rule FROM r), x0 AS (SELECT rule, list_filter(list_transform(regexp_extract_all(rule, '["`]([^"`]+)["`]', 1), lambda x: trim(x)), lambda x: length(x) >= 2) AS quoted,
  list_filter([{', '.join(f"regexp_extract(rule, '(?i){p}')" for p in o.COMPOUNDS)}], lambda x: x <> '') AS comp,
  list_filter(list_transform(regexp_extract_all(rule, '[A-Za-z_*]+(?:\s*\*)?'), lambda w: trim(lower(w))), lambda w: length(w) >= 3 AND NOT list_contains({STOPS}, w)) AS ws FROM q),
 x1 AS (SELECT rule, list_concat(quoted, comp, flatten(list_transform(ws, lambda w: CASE WHEN ends_with(w, 's') THEN CASE WHEN length(w) >= 4 THEN [w, w[:-2]] ELSE [w] END ELSE [w, w || 's'] END))) AS terms FROM x0),
 x2 AS (SELECT rule, terms, list_distinct(list_transform(terms, lambda w: lower(w))) AS low,
   len(list_distinct(list_filter(list_transform(regexp_extract_all(rule, '\b[A-Za-z]{{3,}}\b'), lambda w: lower(w)), lambda w: NOT list_contains({STOPS}, w)))) AS nc FROM x1),
 x AS (SELECT rule, terms, list_filter(low, lambda w: regexp_matches(w, '^\w+$')) AS words, list_filter(low, lambda w: NOT regexp_matches(w, '^\w+$')) AS comps, CASE WHEN nc <= 3 THEN 1 ELSE 2 END AS least FROM x2)"""
FOUND = rf"""{TERMS}, {ERRORS}, b AS (SELECT id, session_id, ts, lower(concat_ws(' ', {', '.join(f"nullif(regexp_replace({f}, '{o.REMINDER}', '', 'g'), '')" for f in o.FIELDS)})) AS txt FROM e),
 h AS (SELECT rule, id, session_id, ts FROM x, b WHERE len(list_intersect(words, list_distinct(regexp_extract_all(txt, '\w+')))) >= least OR len(list_filter(comps, lambda c: contains(txt, c))) > 0)"""


def _rules(s, d):
    return o.parsed(rule_files(s, d))


def _found(s, d):
    return o.violations(o.with_terms(_rules(s, d)), mining.error_records(trace(s, d)))


QUERIES = {
    "parsed_rules": (
        lambda s, d: _rules(s, d),
        f"WITH {PARSED} SELECT * FROM r",
    ),
    "rule_terms": (
        lambda s, d: _rules(s, d).select("rule").distinct().select("rule", F.array_join(o.key_terms(F.col("rule")), "|").alias("terms")),
        f"WITH {TERMS} SELECT rule, array_to_string(terms, '|') AS terms FROM x",
    ),
    "parsed_rule_violations": (
        lambda s, d: _found(s, d).select("rule", "id"),
        f"WITH {FOUND} SELECT rule, id FROM h",
    ),
    "parsed_rule_report": (
        lambda s, d: o.report(_rules(s, d).select("rule").distinct(), _found(s, d), mining.error_records(trace(s, d))),
        f"WITH {FOUND} SELECT q.rule, count(h.id) AS hits, max(ts) AS last_seen, count(DISTINCT session_id) AS sessions FROM q LEFT JOIN h ON h.rule = q.rule GROUP BY 1",
    ),
}
