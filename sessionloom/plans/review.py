"""Queries over chunks, windows, browsing, linkage and summaries."""

from pyspark.sql import functions as F

from sessionloom.functions import tables
from sessionloom.operators import review as o
from sessionloom.plans import curation
from sessionloom.sources.bind import DIALOGUE, STREAM, TRACE, dialogue, table, tool_stream, trace

KINDS = ("idiot", "license", "password", "zebra")


def _linked(s, d):
    changes = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("applied_at"), (F.col("lang") == "de").alias("rolled_back"), "text")
    return o.linked_change(s.createDataFrame([(k,) for k in KINDS], "kind string"), changes)


def _anchors(s, d):
    """Error rows whose instants are off by up to an hour, some without a tool."""
    ts = F.expr("ts - make_interval(0, 0, 0, 0, 0, 0, id % 3 * 1800)")
    return trace(s, d).where("error is not null").select(F.col("id").alias("anchor_id"), "session_id", ts.alias("anchor_ts"), F.when(F.col("id") % 5 > 0, F.col("tool_name")).alias("tool_name"))


def _sessions(s, d):
    return tool_stream(s, d).groupBy("session_id").agg(F.sum("k").alias("tokens"), F.sum("amount").alias("cost"), F.count_if("is_error").alias("errors"), (F.count_if(F.col("tool") == "view") / F.count("*")).alias("cache_ratio"))


def _seen(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("path"), F.col("text").alias("content"), "lang")
    return o.unprocessed(docs, docs.where("lang = 'en'").select("path", F.sha2("content", 256).alias("sha"))).distinct()


def _lateral(s, d, columns, call):
    tables.register(s)
    return s.sql(f"SELECT {columns} FROM {{docs}}, LATERAL {call}", docs=table(s, d, "documents"))


CHUNKS = r"""WITH p AS (SELECT doc_id, generate_subscripts(a, 1) AS g, unnest(a) AS part FROM (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '(?m)^(#{1,6} )', chr(1) || '\1', 'g'), chr(1)), lambda x: x <> '') AS a FROM documents)),
    c AS (SELECT doc_id, g, unnest(range(0, length(part), 500)) AS off, part FROM p), r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, off) - 1 AS INTEGER) AS chunk, substr(part, off + 1, 500) AS body FROM c)
    SELECT doc_id, chunk, md5(body) AS body_md5 FROM r WHERE trim(body) <> ''"""

QUERIES = {
    "markdown_chunks": (
        lambda s, d: o.chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk", F.md5("body").alias("body_md5")),
        CHUNKS,
    ),
    "chunks_by_table_function": (
        lambda s, d: _lateral(s, d, "doc_id, chunk, md5(body) AS body_md5", "text_chunks(text, 500)"),
        CHUNKS,
    ),
    "blocks_by_table_function": (
        lambda s, d: _lateral(s, d, "doc_id, start_line, n_lines, md5(block) AS block_md5", "text_blocks(text)"),
        curation.QUERIES["rule_blocks"][1],
    ),
    "forward_window": (
        lambda s, d: o.forward_window(tool_stream(s, d), F.col("is_error"), 3),
        f"""WITH {STREAM}, w AS (SELECT id, session_id, is_error, lead(tool, 1) OVER q AS a, lead(tool, 2) OVER q AS b, lead(tool, 3) OVER q AS c FROM s WINDOW q AS (PARTITION BY session_id ORDER BY ts, id))
        SELECT id, session_id, concat_ws('>', a, b, c) AS following FROM w WHERE is_error""",
    ),
    "located_windows": (
        lambda s, d: o.located_windows(_anchors(s, d), trace(s, d), 4, 300).select("anchor_id", "session_id", "row_id", "following"),
        f"""WITH {TRACE}, a AS (SELECT id AS anchor_id, session_id, ts - to_seconds(id % 3 * 1800) AS anchor_ts, CASE WHEN id % 5 > 0 THEN tool_name END AS tool_name FROM t WHERE error IS NOT NULL),
        u AS (SELECT session_id, ts, min(id) AS id FROM t GROUP BY 1, 2), y AS (SELECT session_id, ts, tool_name, min(id) AS id FROM t GROUP BY 1, 2, 3),
        l AS (SELECT a.anchor_id, a.session_id, coalesce(y.id, u.id) AS row_id FROM a ASOF LEFT JOIN u ON u.session_id = a.session_id AND u.ts >= a.anchor_ts LEFT JOIN y ON y.session_id = a.session_id AND y.ts = a.anchor_ts AND y.tool_name = a.tool_name),
        x AS (SELECT *, CASE WHEN coalesce(tool_name, '') <> '' THEN '[' || role || '/' || tool_name || '/' || CASE WHEN coalesce(error, '') = '' THEN 'OK' ELSE 'ERR' END || '] ' || replace(left(coalesce(tool_input, ''), 160), chr(10), ' ') || ' → ' || replace(left(coalesce(nullif(output, ''), error, ''), 240), chr(10), ' ')
         WHEN trim(coalesce(content, '')) <> '' THEN '[' || role || '] ' || replace(left(trim(content), 280), chr(10), ' ') END AS line FROM t),
        w AS (SELECT session_id, id, left(array_to_string(list_filter(list(line) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), lambda z: z IS NOT NULL), chr(10)), 300) AS following FROM x)
        SELECT anchor_id, l.session_id, row_id, coalesce(following, '') AS following FROM l LEFT JOIN w ON w.session_id = l.session_id AND w.id = row_id""",
    ),
    "error_browse": (
        lambda s, d: o.latest_of(tool_stream(s, d).where("amount > 5"), "tool", 10).select("tool", "id", "rank", "n"),
        f"WITH {STREAM}, r AS (SELECT tool, id, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, id DESC) AS rank, count(*) OVER (PARTITION BY tool) AS n FROM s WHERE amount > 5) SELECT * FROM r WHERE rank <= 10",
    ),
    "rule_linkage": (
        _linked,
        f"""WITH k(kind) AS (VALUES {', '.join(f"('{k}')" for k in KINDS)}), h AS (SELECT kind, doc_id, row_number() OVER (PARTITION BY kind ORDER BY n_chars DESC, doc_id DESC) AS i FROM documents JOIN k ON contains(lower(text), kind) WHERE lang <> 'de')
        SELECT kind, max(doc_id) FILTER (WHERE i = 1) AS change_id, count(*) AS changes FROM h GROUP BY 1""",
    ),
    "report_summary": (
        lambda s, d: o.report_summary(_sessions(s, d)),
        f"""WITH {STREAM}, m AS (SELECT session_id, sum(k) AS t, sum(amount) AS c, count(*) FILTER (WHERE is_error) AS e, count(*) FILTER (WHERE tool = 'view')::DOUBLE / count(*) AS r FROM s GROUP BY 1)
        SELECT count(*) AS sessions, CAST(sum(t) AS BIGINT) AS tokens, round(sum(c), 2) AS cost, CAST(sum(e) AS BIGINT) AS errors, round(avg(r), 6) AS cache_ratio FROM m""",
    ),
    "dataset_summary": (
        lambda s, d: o.dataset_summary(tool_stream(s, d), "k", 3),
        f"""WITH {STREAM}, e AS (SELECT k, tool, count(*) AS n, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, tool) AS i FROM e)
        SELECT k, CAST(sum(n) AS BIGINT) AS n, min(a) AS first_ts, max(b) AS last_ts, string_agg(tool, ',' ORDER BY i) FILTER (WHERE i <= 3) AS top FROM r GROUP BY 1""",
    ),
    "ground_truth_stats": (
        lambda s, d: o.truth_stats(table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "source"), "doc_id"), "quality", "source"),
        "SELECT l.quality, source, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((l.quality), (source))",
    ),
    "changes_listing": (
        lambda s, d: o.changes_listing(table(s, d, "documents").select(F.col("doc_id").alias("suggestion_id"), "lang", "source"), table(s, d, "labels").select(F.col("doc_id").alias("suggestion_id"), "quality")),
        "SELECT d.doc_id AS suggestion_id, lang, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "routing_dataset": (
        lambda s, d: o.routing(dialogue(s, d)),
        f"""WITH {DIALOGUE}, x AS (SELECT *, coalesce(lag(content) OVER w, '') AS c, lead(role) OVER w AS route FROM m WINDOW w AS (PARTITION BY session_id ORDER BY idx))
        SELECT session_id, idx, substr(content, 1, 500) AS message, substr(c, 1, 300) AS context, route FROM x WHERE role = 'user' AND route IS NOT NULL""",
    ),
    "phase_labels": (
        lambda s, d: o.phases(tool_stream(s, d)),
        f"""WITH {STREAM}, p AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ts, id) - 1)::DOUBLE / count(*) OVER (PARTITION BY session_id) AS p FROM s)
        SELECT session_id, CASE WHEN p < 0.3::DOUBLE THEN 'explore' WHEN p < 0.8::DOUBLE THEN 'implement' ELSE 'verify' END AS phase, count(*) AS n, count(*) FILTER (WHERE is_error) AS errors FROM p GROUP BY 1, 2""",
    ),
    "unprocessed_files": (
        _seen,
        "SELECT DISTINCT source AS path, sha256(text) AS sha FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source AND e.text = d.text)",
    ),
    "cycle_supersede": (
        lambda s, d: o.superseded(table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("cycle")), "o_custkey", "cycle").groupBy("o_custkey").agg(F.count_if("active").alias("active"), F.count("*").alias("n")),
        "WITH x AS (SELECT o_custkey, year(o_orderdate) AS c, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT o_custkey, count(*) FILTER (WHERE c = m) AS active, count(*) AS n FROM x GROUP BY 1",
    ),
}
