"""Queries over flows of traces, exports, examples, clusters and text kernels."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import leader, mining
from sessionloom.operators import exports as o
from sessionloom.plans.distill import JUDGED, SUMMARY
from sessionloom.plans.mining import ERRORS
from sessionloom.sources.bind import TALK, TRACE, table, talk, trace

W = "(PARTITION BY session_id ORDER BY ts, id"
ENDS = ", ".join(f"'{x}'" for x in o.ENDINGS)
SAMPLES = (
    "group_id Unexpected keyword argument", "entity_types Input should be a valid list", "12000 tokens) exceeds maximum of 9000", "Status: 404 for x", "Cloud ID: 0123456789abcdef01234567", "1 error for call[search_nodes]", "nothing here",
    "Unexpected keyword argument: limit", "- Input should be a valid number [type=x, input_value=many]", "(12.5MB) exceeds maximum allowed size of 10MB", "Failed to fetch page for user: host/page now",
)
RAW = ("Claude MD rule", "hook-config", "hook_confg", "settings", "MCP config", "nonsense", "", "agent profil", "skill update")

EXT = rf"""CASE WHEN regexp_extract(v, '"skill"\s*:\s*"([a-zA-Z0-9_:-]+)"', 1) <> '' THEN '.' || regexp_extract(v, '"skill"\s*:\s*"([a-zA-Z0-9_:-]+)"', 1) WHEN lower(regexp_extract(v, '["'']([^"'']+\.(\w{{1,6}}))["'']', 2)) IN ({ENDS}) THEN '.' || lower(regexp_extract(v, '["'']([^"'']+\.(\w{{1,6}}))["'']', 2)) ELSE '' END"""
FLOWS = f"""{TRACE}, v0 AS (SELECT *, coalesce(tool_input, '') AS v, coalesce(first_value(CASE WHEN role = 'user' THEN coalesce(trim(content) <> '' AND regexp_matches(content, '(?i){t.PRAISE}'), false) END IGNORE NULLS) OVER {W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS praised FROM t),
 q AS (SELECT id, session_id, ts, praised, tool_name || {EXT} AS tool FROM v0 WHERE tool_name IS NOT NULL),
 i AS (SELECT *, CASE WHEN coalesce(lag(tool) OVER {W}), '') <> tool THEN 1 ELSE 0 END AS fresh, row_number() OVER {W}) - 1 AS place FROM q), j AS (SELECT *, sum(fresh) OVER {W}) AS run FROM i),
 r AS (SELECT session_id, run, CASE WHEN count(*) > 1 THEN min(tool) || '+' ELSE min(tool) END AS key, min(ts) AS ts, max(CAST(praised AS INTEGER)) AS praised FROM j GROUP BY 1, 2),
 g AS (SELECT session_id, run, ts, n AS size, list(key) OVER w AS ks, list(praised) OVER w AS gs FROM r, (SELECT unnest([2, 3, 4, 5]) AS n) WINDOW w AS (PARTITION BY session_id, n ORDER BY run ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
 h AS (SELECT session_id, run, ts, size, array_to_string(ks[1:size], ' → ') AS sequence, list_max(gs[1:size]) AS success FROM g WHERE len(ks) >= size),
 sp AS (SELECT session_id, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS span FROM q GROUP BY 1), gn AS (SELECT session_id, count(*) AS grams FROM h GROUP BY 1),
 e AS (SELECT x.*, span / grams AS duration FROM (SELECT *, substr(sha256(sequence), 1, 16) AS flow_hash, row_number() OVER (PARTITION BY session_id, sequence ORDER BY size, run) AS rn FROM h) x JOIN sp ON sp.session_id = x.session_id JOIN gn ON gn.session_id = x.session_id WHERE rn = 1)"""
PAIRS = f"""{FLOWS}, tw AS (SELECT flow_hash, CAST(sum(success) AS BIGINT) AS successes, CAST(sum(1 - success) AS BIGINT) AS failures FROM e GROUP BY 1 HAVING sum(success) >= 3 AND sum(1 - success) >= 3),
 sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_hash, success ORDER BY md5('7|' || flow_hash || '|' || session_id), session_id) AS k FROM e) WHERE k <= 3)"""


def _errors(s, d):
    return mining.error_records(trace(s, d))


def _hits(s, d):
    """Errors with a vector of their text and input, and whether the text holds a word."""
    said = F.concat_ws(" ", "error_text", "tool_input")
    return _errors(s, d).select("id", o.word_vector(said).alias("vec"), F.contains("error_text", F.lit("syntax")).alias("hit"))


HITS = f"""{ERRORS}, v AS MATERIALIZED (SELECT id, list_transform(string_split('0123456789abcdef', ''), lambda x: len(list_filter(list_transform(regexp_extract_all(lower(concat_ws(' ', error_text, tool_input)), '[{t.LETTERS}]+'), lambda w: left(md5(w), 1)), lambda y: y = x))::DOUBLE) AS vec,
 contains(error_text, 'syntax') AS hit FROM e)"""


def _leaders(name, rows, threshold=0.85):
    """SQL of the sequential rule, a row a step: (id, cluster)."""
    dot = lambda a, b: f"list_sum(list_transform(range(1, 17), lambda z: {a}[z] * {b}[z]))"
    return f"""{name}_x AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS k FROM ({rows})),
    {name} AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS cluster, []::STRUCT(s DOUBLE[], n BIGINT, f BIGINT)[] AS c
     UNION ALL SELECT k, id, CASE WHEN m >= {threshold} THEN c[list_position(sims, m)].f ELSE id END,
      CASE WHEN m >= {threshold} THEN list_transform(c, lambda y, i: CASE WHEN i = list_position(sims, m) THEN {{'s': list_transform(range(1, 17), lambda z: y.s[z] + vec[z]), 'n': y.n + 1, 'f': y.f}} ELSE y END) ELSE list_append(c, {{'s': vec, 'n': 1::BIGINT, 'f': id}}) END
     FROM (SELECT *, list_max(sims) AS m FROM (SELECT x.k, x.id, x.vec, o.c, list_transform(o.c, lambda y: {dot('y.s', 'x.vec')} / (sqrt({dot('y.s', 'y.s')}) * sqrt({dot('x.vec', 'x.vec')}))) AS sims FROM {name} AS o JOIN {name}_x AS x ON x.k = o.k + 1)))"""


def _truth(s, d):
    docs = table(s, d, "documents").select("doc_id", "lang", "source", F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 9).alias("lines"))
    j = F.to_json(F.transform("lines", lambda x: F.struct(x.alias("error_text"))))
    lab = table(s, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("error_type"), F.col("source").alias("pattern_summary"), F.when(F.col("doc_id") % 3 > 0, j).alias("examples_json"), "label")


def _changes(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("applied_at"), F.when(F.col("o_orderpriority") == "5-LOW", "x").alias("superseded_at"))


def _samples(s, d):
    return trace(s, d).select("session_id", F.struct("ts", "id").alias("at"), F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("id") % len(SAMPLES) + 1).cast("int")).alias("text"))


def _members(s, d):
    return _errors(s, d).select("id", F.col("command_category").alias("cluster"), "tool_name", F.when(F.col("id") % 4 == 0, "").when(F.col("tool_name") == "Read", None).otherwise("Tool-Failure " + "x").alias("error_type"), "error_text")


def _cache(s, d):
    e = table(s, d, "embeddings")
    return e.select(F.concat(F.lit("d"), (F.col("vec_id") % 700).cast("string")).alias("description"), F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("model"), F.col("vec_id").alias("vector"))


def _usage(s, d):
    return trace(s, d).select(
        "session_id", F.when(F.col("id") % 3 == 0, "small").otherwise("large").alias("model"), F.when(F.col("id") % 5 == 0, "end_turn").when(F.col("id") % 5 == 1, "tool_use").alias("stop_reason"),
        F.col("k").cast("long").alias("tokens_in"), (F.col("k") * 3).cast("long").alias("tokens_out"), (F.col("k") % 10).cast("long").alias("cache_read"), F.col("amount").alias("cost"),
    )


TOK = f"list_distinct(regexp_extract_all(lower(coalesce({{}}, '')), '[{t.LETTERS}]+'))"

QUERIES = {
    "flow_run_members": (
        lambda s, d: o.run_members(o.tool_stream(trace(s, d))).select("session_id", "run", "tool", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places")),
        f"WITH {FLOWS} SELECT session_id, CAST(run AS BIGINT) AS run, min(tool) AS tool, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS places FROM j GROUP BY 1, 2",
    ),
    "flow_events": (
        lambda s, d: o.flow_events(o.tool_stream(trace(s, d))).select("session_id", "flow_hash", "sequence", "success", "ts", F.round("duration", 3).alias("duration")),
        f"WITH {FLOWS} SELECT session_id, flow_hash, sequence, success, ts, round(duration, 3) AS duration FROM e",
    ),
    "twin_pairs": (
        lambda s, d: o.twin_pairs(o.flow_events(o.tool_stream(trace(s, d)))).select("flow_hash", "sequence", "successes", "failures", F.array_join(F.transform("samples", lambda x: F.concat(x["outcome"], F.lit(":"), x["session_id"].cast("string"))), ",").alias("samples")),
        f"WITH {PAIRS} SELECT sm.flow_hash, sequence, successes, failures, string_agg(CASE success WHEN 1 THEN 'success' ELSE 'failure' END || ':' || session_id, ',' ORDER BY success = 1, session_id, ts) AS samples FROM sm JOIN tw ON tw.flow_hash = sm.flow_hash GROUP BY 1, 2, 3, 4",
    ),
    "twin_positives": (
        lambda s, d: o.twin_positives(o.twin_pairs(o.flow_events(o.tool_stream(trace(s, d))))).select("flow_hash", "session_id", "ts", "successes", F.array_join(F.transform("failure_sessions", lambda x: x.cast("string")), ",").alias("failure_sessions")),
        f"WITH {PAIRS}, fl AS (SELECT flow_hash, array_to_string((list(session_id ORDER BY session_id, ts))[1:3], ',') AS failure_sessions FROM sm WHERE success = 0 GROUP BY 1) SELECT sm.flow_hash, session_id, ts, successes, failure_sessions FROM sm JOIN tw ON tw.flow_hash = sm.flow_hash JOIN fl ON fl.flow_hash = sm.flow_hash WHERE success = 1",
    ),
    "flow_skills": (
        lambda s, d: o.flow_skills(o.flow_events(o.tool_stream(trace(s, d)))),
        f"""WITH {FLOWS} SELECT flow_hash, sequence, count(*) AS n, round(avg(CAST(success AS DOUBLE)), 6) AS rate, array_to_string((list(CAST(session_id AS VARCHAR) ORDER BY ts, CAST(session_id AS VARCHAR)))[1:10], ',') AS examples,
        'flow-' || array_to_string(list_transform(string_split(sequence, ' → ')[1:4], lambda x: lower(replace(translate(trim(x), '()+ ', ''), '.', '_'))), '-') AS slug FROM e GROUP BY 1, 2 HAVING count(*) >= 2""",
    ),
    "flat_examples": (
        lambda s, d: o.flattened(o.examples(_errors(s, d)).select(F.col("data._meta.error_record_id").alias("id"), "inputs", F.struct("data.pattern_description", "data.example_errors", "data.project_context", "data.rule_title").alias("data"))),
        f"""WITH {ERRORS} SELECT id, '["pattern_description","example_errors","project_context"]' AS inputs, to_json({{'pattern_description': '[' || error_type || '] ' || substr(error_text, 1, 300), 'example_errors': [substr(error_text, 1, 500)], 'project_context': substr(coalesce(context_before, ''), 1, 500), 'rule_title': ''}}) AS data FROM e""",
    ),
    "collected_errors": (
        lambda s, d: o.collected(_errors(s, d), "2024-01-12 00:00:00", "tool_failure", table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("session_id")).where("c_mktsegment = 'BUILDING'")).select("id", "session_id"),
        f"WITH {ERRORS} SELECT id, session_id FROM e WHERE ts >= TIMESTAMP '2024-01-12' AND session_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')",
    ),
    "training_corpus": (
        lambda s, d: o.corpus(_truth(s, d)).select("id", "pattern_description", F.size("example_errors").alias("n"), F.md5(F.array_join("example_errors", "|")).alias("examples_md5")),
        r"""WITH x AS (SELECT d.doc_id AS id, lang, source, CASE WHEN d.doc_id % 3 > 0 THEN list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1:5], lambda l: substr(l, 1, 500)) ELSE [] END AS ls FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1),
        y AS (SELECT *, CASE WHEN len(ls) > 0 THEN ls WHEN coalesce(source, '') = '' THEN ['No example available'] ELSE [source] END AS es FROM x)
        SELECT id, CASE WHEN coalesce(lang, '') <> '' AND coalesce(source, '') <> '' THEN '[' || lang || '] ' || source WHEN coalesce(source, '') <> '' THEN source ELSE coalesce(lang, '') END AS pattern_description, CAST(len(es) AS INTEGER) AS n, md5(array_to_string(es, '|')) AS examples_md5 FROM y""",
    ),
    "active_changes": (
        lambda s, d: o.active_changes(_changes(s, d)).select("id", "target", "place"),
        "SELECT o_orderkey AS id, o_custkey AS target, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders WHERE o_orderpriority <> '5-LOW'",
    ),
    "label_matches": (
        lambda s, d: table(s, d, "labels").groupBy(o.exact_match(F.col("quality"), F.col("toxic")).alias("same")).agg(F.count("*").alias("n")),
        "SELECT quality IS NOT DISTINCT FROM toxic AS same, count(*) AS n FROM labels GROUP BY 1",
    ),
    "snapped_surfaces": (
        lambda s, d: o.snapped(trace(s, d).select("id", F.element_at(F.array(*map(F.lit, RAW)), (F.col("id") % len(RAW) + 1).cast("int")).alias("raw")), "raw").groupBy("raw", "surface").agg(F.count("*").alias("n")),
        None,
    ),
    "error_variables": (
        lambda s, d: o.variables(_samples(s, d), "session_id", "text", "at"),
        f"WITH {TRACE}, x AS (SELECT session_id, ts, id, ([{', '.join(f'''{chr(39)}{x}{chr(39)}''' for x in SAMPLES)}])[id % {len(SAMPLES)} + 1] AS text FROM t) SELECT session_id, " + ", ".join(f"arg_max({o.told_sql('text', p, u)}, {{'t': ts, 'i': id}}) FILTER (WHERE {o.told_sql('text', p, u)} IS NOT NULL) AS {n}" for n, p, u in o.VARIABLES) + " FROM x GROUP BY 1",
    ),
    "cluster_terms": (
        lambda s, d: o.dominant_term(_members(s, d), "cluster"),
        f"""WITH {ERRORS}, x AS (SELECT command_category AS cluster, CASE WHEN id % 4 = 0 OR tool_name = 'Read' THEN NULL ELSE 'Tool-Failure x' END AS kind, nullif(substr(regexp_extract(lower(error_text), '^[a-z][a-z0-9_]*'), 1, 20), '') AS word FROM e),
        a AS (SELECT cluster, kind, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, kind) AS r FROM x WHERE kind IS NOT NULL GROUP BY 1, 2), b AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, word) AS r FROM x WHERE word IS NOT NULL GROUP BY 1, 2)
        SELECT c.cluster, coalesce(nullif(trim(substr(regexp_replace(lower(kind), '[^a-z0-9_]+', '_', 'g'), 1, 30), '_'), ''), word, 'error') AS term FROM (SELECT DISTINCT cluster FROM x) c LEFT JOIN a ON a.cluster = c.cluster AND a.r = 1 LEFT JOIN b ON b.cluster = c.cluster AND b.r = 1""",
    ),
    "reused_vectors": (
        lambda s, d: o.reused_vectors(table(s, d, "documents").select("doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 900).cast("string")).alias("description")), _cache(s, d), "a").select("doc_id", F.col("vector").alias("vec_id")),
        "WITH c AS (SELECT 'd' || vec_id % 700 AS description, max(vec_id) AS v FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT doc_id, v AS vec_id FROM documents LEFT JOIN c ON c.description = 'd' || doc_id % 900",
    ),
    "token_overlaps": (
        lambda s, d: talk(s, d).withColumn("nxt", F.expr("lead(content) OVER (PARTITION BY session_id ORDER BY idx)")).where("nxt is not null").select("session_id", "idx", F.round(o.token_overlap(F.col("content"), F.col("nxt")), 6).alias("overlap")),
        f"WITH {TALK}, n AS (SELECT *, lead(content) OVER (PARTITION BY session_id ORDER BY idx) AS nxt FROM m), x AS (SELECT session_id, idx, {TOK.format('content')} AS a, {TOK.format('nxt')} AS b FROM n WHERE nxt IS NOT NULL) SELECT session_id, idx, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) END, 6) AS overlap FROM x",
    ),
    "hybrid_clusters": (
        lambda s, d: leader.hybrid(_hits(s, d)),
        f"WITH RECURSIVE {HITS}, {_leaders('o', 'SELECT * FROM v WHERE hit')} SELECT id, CASE WHEN (SELECT count(*) FROM v WHERE hit) > 1 THEN cluster END AS cluster FROM o WHERE id IS NOT NULL",
    ),
    "recluster": (
        lambda s, d: leader.reclustered(_hits(s, d)),
        f"""WITH RECURSIVE {HITS}, {_leaders('o', 'SELECT * FROM v')}, k AS (SELECT DISTINCT cluster FROM o JOIN v USING (id) WHERE hit), {_leaders('q', 'SELECT v.* FROM v JOIN o USING (id) WHERE cluster IN (SELECT cluster FROM k)')}
        SELECT id, cluster FROM q WHERE id IS NOT NULL""",
    ),
    "error_categories": (
        lambda s, d: (x := _errors(s, d).withColumn("category", o.category(F.col("error_text")))).select("id", "category", o.category_slug(F.when(F.col("id") % 3 == 0, "repeated_attempt").otherwise(F.col("error_type")), F.col("tool_name"), F.col("category"), "2024").alias("slug")),
        f"WITH {ERRORS}, x AS (SELECT *, CASE {' '.join(f'''WHEN regexp_matches(error_text, {chr(39)}(?i){p}{chr(39)}) THEN {chr(39)}{n}{chr(39)}''' for n, p in o.CATEGORIES)} ELSE 'Other' END AS category FROM e) SELECT id, category, CASE WHEN id % 3 = 0 THEN 'repeated_attempt__' || lower(tool_name) ELSE error_type || '__' || lower(category) || '__2024' END AS slug FROM x",
    ),
    "embedded_texts": (
        lambda s, d: o.embedded(talk(s, d).where("role = 'user'"), "content", talk(s, d).where("role = 'user' and idx = 0").select(F.sha2(F.coalesce("content", F.lit("")), 256).alias("key")).distinct().withColumn("vector", F.array_repeat(F.lit(0.5), 16))).select("session_id", "idx", "key", "cached", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("vector")),
        f"""WITH {TALK}, c AS (SELECT DISTINCT sha256(content) AS key FROM m WHERE role = 'user' AND idx = 0), x AS (SELECT session_id, idx, sha256(content) AS key, list_transform(regexp_extract_all(lower(content), '[{t.LETTERS}]+'), lambda w: substr(md5(w), 1, 1)) AS ds FROM m WHERE role = 'user')
        SELECT session_id, idx, x.key, c.key IS NOT NULL AS cached, CASE WHEN c.key IS NOT NULL THEN array_to_string(list_transform(range(16), lambda i: '0.5'), ',') ELSE array_to_string(list_transform(string_split('0123456789abcdef', ''), lambda h: len(list_filter(ds, lambda y: y = h)) || '.0'), ',') END AS vector FROM x LEFT JOIN c ON c.key = x.key""",
    ),
    "traced_struggles": (
        lambda s, d: o.struggles(o.all_steps(trace(s, d))),
        f"""WITH {JUDGED}, k0 AS (SELECT *, CASE WHEN json_valid(tool_input) THEN tool_input END AS j FROM t WHERE tool_name IS NOT NULL), k1 AS (SELECT *, {SUMMARY} AS summary, CAST(row_number() OVER {W}) AS INTEGER) AS num FROM k0),
        s AS (SELECT session_id, num, tool_name AS tool, summary, regexp_extract_all(summary, '{o.FILE}') AS fs, regexp_matches(concat_ws(' ', output, summary), '{o.STRUGGLE}') AS bad, regexp_matches(coalesce(output, ''), '{o.STRUGGLE}') AS bad_out FROM k1)
        SELECT a.session_id, a.num AS failure_step, min(b.num) AS fix_step FROM s a JOIN s b ON b.session_id = a.session_id AND b.num BETWEEN a.num + 1 AND a.num + 3 AND (b.tool = a.tool OR list_has_any(a.fs, b.fs)) AND NOT b.bad_out WHERE a.bad GROUP BY 1, 2""",
    ),
    "session_usage": (
        lambda s, d: o.session_usage(_usage(s, d)),
        f"""WITH {TRACE}, u AS (SELECT session_id, CASE WHEN id % 3 = 0 THEN 'small' ELSE 'large' END AS model, CASE id % 5 WHEN 0 THEN 'end_turn' WHEN 1 THEN 'tool_use' END AS stop_reason, k, amount FROM t),
        a AS (SELECT session_id, CAST(sum(k) AS BIGINT) AS tokens_in, CAST(sum(k * 3) AS BIGINT) AS tokens_out, CAST(sum(k % 10) AS BIGINT) AS cache_read, round(sum(amount), 4) AS cost FROM u GROUP BY 1), b AS (SELECT session_id, string_agg(x, ',' ORDER BY x) AS stop_reasons FROM (SELECT session_id, stop_reason || '=' || count(*) AS x FROM u WHERE stop_reason IS NOT NULL GROUP BY session_id, stop_reason) GROUP BY 1),
        c AS (SELECT session_id, model FROM (SELECT session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, model) AS r FROM u GROUP BY 1, 2) WHERE r = 1)
        SELECT a.*, round(coalesce(cache_read::DOUBLE / nullif(cache_read + tokens_in, 0), 0), 6) AS cache_ratio, stop_reasons, model FROM a LEFT JOIN b ON b.session_id = a.session_id LEFT JOIN c ON c.session_id = a.session_id""",
    ),
    "project_lifecycle": (
        lambda s, d: o.lifecycle(_errors(s, d)),
        f"""WITH {ERRORS}, dy AS (SELECT project_tag, command_category, error_type, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS a, max(ts) AS z FROM e GROUP BY 1, 2, 3, 4), x AS (SELECT project_tag, command_category, error_type, CAST(sum(n) AS BIGINT) AS total, min(a) AS first, max(z) AS last, max(n) AS peak FROM dy GROUP BY 1, 2, 3 HAVING sum(n) >= 5),
        y AS (SELECT x.*, (SELECT count(*) FROM e WHERE e.project_tag = x.project_tag AND e.ts > x.last) AS after, CAST(floor(date_diff('microsecond', last, (SELECT max(ts) FROM e)) / 86400e6) AS BIGINT) AS idle FROM x)
        SELECT *, CASE WHEN idle <= 3 THEN 'ACTIVE' WHEN peak >= 3 AND after >= 15 THEN 'FIXED' WHEN peak >= 3 THEN 'DORMANT' ELSE 'MINOR' END AS life FROM y""",
    ),
}
