"""Queries over rule texts, gold examples, registries, feedback, costs and review lists."""

from pyspark.sql import functions as F

from sessionloom.operators import curation as o
from sessionloom.sources.bind import DIALOGUE, STREAM, dialogue, table, tool_stream

PRICES = (("view", 0.5, 1.5), ("click", 2.0, 8.0), ("purchase", 3.0, 15.0))
BANNED = ("idiot", "moron", "password")
NEXT = f"{DIALOGUE}, x AS (SELECT *, lead(content) OVER (PARTITION BY session_id ORDER BY idx) AS nxt FROM m)"
TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''))"


def _pairs(s, d):
    return o.with_next(dialogue(s, d)).where("next_content is not null")


def _customers(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("pattern_id"), (F.col("c_acctbal") > 0).cast("int").alias("label"), "c_mktsegment")


def _accumulated(s, d):
    nation, every = table(s, d, "nation"), _customers(s, d)
    patterns = nation.select(F.col("n_nationkey").alias("pattern_id"), F.col("n_regionkey").alias("tool"))
    new = every.join(patterns, "pattern_id").select("id", "tool", "label")
    return o.accumulated(every.where("c_mktsegment = 'BUILDING'"), new, patterns, 5)


def _grades(s, d):
    last = table(s, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_error"), F.min("o_orderpriority").alias("p"))
    return o.grade_changes(last.withColumn("grade", F.when(F.col("p") == "1-URGENT", "established").when(F.col("p") == "2-HIGH", "dead")), "1998-12-01")


def _candidates(s, d):
    r = table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("sessions"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("rate"),
        F.count_if(F.col("l_quantity") > 45).alias("flows"), (F.count_if(F.col("l_linestatus") == "O") / F.count("*")).alias("tool_share"), (F.count_if(F.col("l_discount") > 0.05) / F.count("*")).alias("repo_share"),
    )
    return o.candidate(r).select("id", "kind", "confidence", "priority")


def _usage(s, d):
    return tool_stream(s, d).select(F.col("tool").alias("model"), F.to_date("ts").cast("string").alias("day"), F.col("k").cast("long").alias("tokens_in"), (F.col("k") * 3).cast("long").alias("tokens_out"), F.col("amount").alias("cost"))


def _estimates(s, d):
    runs = _usage(s, d).groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("in_tokens"), F.sum("tokens_out").alias("out_tokens"))
    out = o.estimated(runs, s.createDataFrame(list(PRICES), "model string, price_in double, price_out double"))
    return out.select("model", "calls", *[F.round(c, 4).alias(c) for c in ("low", "mid", "high")])


def _quality(s, d):
    pairs = _pairs(s, d).select("session_id", "idx", F.when(F.col("role") == "user", "user_correction").when(F.col("role") == "assistant", "undo").alias("error_type"), F.col("role").alias("tool"), F.col("content").alias("errors"), F.col("next_content").alias("rule"))
    return o.quality(pairs).select("session_id", "idx", *[F.round(c, 6).alias(c) for c in ("specificity", "actionability", "surface", "score")])


VERBS = ", ".join(f"'{v}'" for v in o.VERBS)

QUERIES = {
    "rule_blocks": (
        lambda s, d: o.rule_blocks(table(s, d, "documents")).select("doc_id", "start_line", "n_lines", F.md5("block").alias("block_md5")),
        r"""WITH l AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS p FROM documents)),
        f AS (SELECT *, trim(line) = '' AS blank, regexp_matches(ltrim(line), '^#{1,6}\s') AS head FROM l),
        g AS (SELECT *, CAST(NOT blank AND (coalesce(lag(blank) OVER w, TRUE) OR head) AS INTEGER) AS st FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM g)
        SELECT doc_id, CAST(min(i) AS INTEGER) AS start_line, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS block_md5 FROM b WHERE NOT blank GROUP BY doc_id, blk""",
    ),
    "line_budget": (
        lambda s, d: o.line_budget(table(s, d, "pages"), "html", 3, 20).select("page_id", "n_lines", "status"),
        r"""WITH x AS (SELECT page_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '\r?\n'), lambda l: regexp_matches(l, '\S'))) AS BIGINT) AS n_lines FROM pages)
        SELECT *, CASE WHEN n_lines + 3 <= 20 THEN 'ok' WHEN n_lines >= 20 THEN 'blocked' ELSE 'consolidate' END AS status FROM x""",
    ),
    "merge_proposals": (
        lambda s, d: _pairs(s, d).select("session_id", "idx", F.md5(o.merged_text(F.col("content"), F.col("next_content"))).alias("merged_md5")),
        f"""WITH {NEXT}, y AS (SELECT *, CASE WHEN length(content) >= length(nxt) THEN content ELSE nxt END AS base, CASE WHEN length(content) >= length(nxt) THEN nxt ELSE content END AS other FROM x WHERE nxt IS NOT NULL),
        z AS (SELECT *, list_filter(string_split(other, chr(10)), lambda l: trim(l) <> '' AND NOT list_contains(list_transform(string_split(base, chr(10)), lambda q: trim(q)), trim(l))) AS extra FROM y)
        SELECT session_id, idx, md5(CASE WHEN len(extra) > 0 THEN base || chr(10) || array_to_string(extra, chr(10)) ELSE base END) AS merged_md5 FROM z""",
    ),
    "consolidated_blocks": (
        lambda s, d: o.consolidated(dialogue(s, d).select("session_id", F.col("idx").alias("id"), F.col("content").alias("text")), "session_id", 0.85).select("session_id", "id", F.md5("text").alias("text_md5")),
        None,
    ),
    "drift_checks": (
        lambda s, d: o.drift(_pairs(s, d).select("session_id", "idx", F.col("content").alias("a"), F.col("next_content").alias("b"))).select("session_id", "idx", F.round("ratio", 6).alias("ratio"), "collision", "needs_approval"),
        None,
    ),
    "gold_first": (
        lambda s, d: o.gold(table(s, d, "lineitem").select(F.col("l_orderkey").alias("invocation"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("message"), (F.col("l_returnflag") == "N").cast("int").alias("user_satisfied"), (F.col("l_linestatus") == "O").cast("int").alias("correct_outcome"))),
        "SELECT l_orderkey AS invocation, min(l_partkey * 10 + l_linenumber) AS id, 'N' AS message FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY 1",
    ),
    "gold_replay": (
        lambda s, d: o.gold_replay(_pairs(s, d).where("role = 'user'").select("session_id", "idx", F.col("content").alias("gold"), F.col("next_content").alias("prompt"))).select("session_id", "idx", F.round("overlap", 6).alias("overlap"), "passes"),
        f"""WITH {NEXT}, y AS (SELECT session_id, idx, {TERMS.format('content')} AS g, {TERMS.format('nxt')} AS p FROM x WHERE nxt IS NOT NULL AND role = 'user'),
        z AS (SELECT *, CASE WHEN len(g) > 0 THEN len(list_intersect(g, p))::DOUBLE / len(g) END AS v FROM y) SELECT session_id, idx, round(v, 6) AS overlap, coalesce(v >= 0.3, TRUE) AS passes FROM z""",
    ),
    "quality_scores": (
        _quality,
        rf"""WITH {NEXT}, y AS (SELECT session_id, idx, role, lower(nxt) AS body, list_distinct(list_append(regexp_extract_all(lower(content), '[a-z_]{{3,}}'), lower(role))) AS det FROM x WHERE nxt IS NOT NULL),
        u AS (SELECT *, CASE WHEN contains(body, 'hook') THEN 'hook_config' WHEN contains(body, 'skill') OR contains(body, 'prompt') THEN 'skill_update' WHEN contains(body, 'mcp') THEN 'mcp_config' WHEN contains(body, 'settings') THEN 'settings_config' WHEN contains(body, 'agent') OR contains(body, 'profile') THEN 'agent_profile' ELSE 'claude_md_rule' END AS sf FROM y),
        z AS (SELECT session_id, idx, CASE WHEN body = '' THEN 0.0 ELSE len(list_filter(det, lambda w: contains(body, w)))::DOUBLE / len(det) END AS sp,
          0.5::DOUBLE * least(len(list_intersect(list_distinct(regexp_extract_all(body, '[a-z]+')), [{VERBS}]))::DOUBLE / 3, 1.0::DOUBLE) + CASE WHEN regexp_matches(body, '{o.PATHS}') THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(body, '`[^`]+`') THEN 0.25::DOUBLE ELSE 0 END AS ac,
          CASE WHEN role = 'user' AND sf IN ('claude_md_rule', 'agent_profile') OR role = 'assistant' AND sf IN ('claude_md_rule', 'settings_config') THEN 1.0::DOUBLE WHEN sf = 'claude_md_rule' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS su FROM u)
        SELECT session_id, idx, round(sp, 6) AS specificity, round(ac, 6) AS actionability, round(su, 6) AS surface, round(least(greatest(0.35::DOUBLE * sp + 0.35::DOUBLE * ac + 0.30::DOUBLE * su, 0), 1), 6) AS score FROM z""",
    ),
    "search_feedback": (
        lambda s, d: o.search_feedback(tool_stream(s, d), F.col("tool").isin("view", "click"), F.col("tool") == "view", F.col("is_error"), 6 * 3600),
        f"""WITH {STREAM}, c AS (SELECT f.id, f.session_id, x.id AS sid, x.tool, x.ts, f.ts AS fts, row_number() OVER (PARTITION BY f.id ORDER BY x.ts DESC, x.id DESC) AS r FROM s f JOIN s x ON x.session_id = f.session_id AND (x.ts < f.ts OR x.ts = f.ts AND x.id < f.id) WHERE f.is_error AND x.tool IN ('view', 'click')),
        g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS q FROM c WHERE r <= 25 AND tool = 'view') SELECT id, session_id, sid AS search_id FROM g WHERE q = 1 AND ts >= fts - INTERVAL 6 HOUR""",
    ),
    "trainset_registry": (
        lambda s, d: o.registry(table(s, d, "documents"), "text", "doc_id"),
        "SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS id, count(*) AS copies, CAST(min(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS rows FROM documents GROUP BY 1",
    ),
    "lineage_sessions": (
        lambda s, d: o.lineage(table(s, d, "lineitem").select((F.col("l_partkey") % 97).alias("dataset"), F.col("l_suppkey").alias("session"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")), "dataset", "session", "at").select("dataset", F.array_join(F.transform("sessions", lambda x: x.cast("string")), ",").alias("sessions")),
        "WITH f AS (SELECT l_partkey % 97 AS dataset, l_suppkey AS session, min(l_orderkey * 10 + l_linenumber) AS t FROM lineitem GROUP BY 1, 2) SELECT dataset, string_agg(CAST(session AS VARCHAR), ',' ORDER BY t, session) AS sessions FROM f GROUP BY 1",
    ),
    "dataset_accumulate": (
        _accumulated,
        """WITH p AS (SELECT n_nationkey AS pattern_id, n_regionkey AS tool FROM nation), c AS (SELECT c_custkey AS id, c_nationkey AS pattern_id, CAST(c_acctbal > 0 AS INTEGER) AS label, c_mktsegment AS seg FROM customer),
        e AS (SELECT pattern_id, id, label, 0 AS fresh FROM c WHERE seg = 'BUILDING' UNION ALL SELECT p.pattern_id, c.id, c.label, 1 FROM c JOIN p q ON q.pattern_id = c.pattern_id JOIN p ON p.tool = q.tool),
        u AS (SELECT pattern_id, id, arg_min(label, fresh) AS label, min(fresh) AS fresh FROM e GROUP BY 1, 2)
        SELECT pattern_id, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, count(*) FILTER (WHERE fresh = 0) AS kept, count(*) AS n, count(*) FILTER (WHERE fresh = 0) = 0 AS created FROM u GROUP BY 1 HAVING count(*) FILTER (WHERE fresh = 0) > 0 OR count(*) >= 5""",
    ),
    "resume_cursor": (
        lambda s, d: o.after_cursor(tool_stream(s, d), tool_stream(s, d).where("ts < timestamp_ntz'2024-01-15 00:00:00' and is_error").groupBy("session_id").agg(F.max("ts").alias("cursor"))).select("id", "session_id", "tool", "ts"),
        f"WITH {STREAM}, c AS (SELECT session_id, max(ts) AS cursor FROM s WHERE ts < TIMESTAMP '2024-01-15' AND is_error GROUP BY 1) SELECT id, s.session_id, tool, ts FROM s LEFT JOIN c ON c.session_id = s.session_id WHERE cursor IS NULL OR ts > cursor",
    ),
    "active_sessions": (
        lambda s, d: o.active_sessions(tool_stream(s, d), F.col("session_id") % 20, "2024-01-10 00:00:00", 720),
        f"""WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS n FROM s WHERE ts <= TIMESTAMP '2024-01-10' AND ts > TIMESTAMP '2024-01-10' - INTERVAL 720 MINUTE)
        SELECT session_id, id, tool, session_id % 20 AS root, ts, count(*) OVER (PARTITION BY session_id % 20) > 1 AS collision FROM r WHERE n = 1""",
    ),
    "tail_replay": (
        lambda s, d: o.tail(tool_stream(s, d), 3).select("session_id", "back", "id", "tool"),
        f"WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS back FROM s) SELECT session_id, back, id, tool FROM r WHERE back <= 3",
    ),
    "usage_rollup": (
        lambda s, d: o.rolled_up(_usage(s, d)),
        f"""WITH {STREAM} SELECT tool AS model, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens_in, CAST(sum(k * 3) AS BIGINT) AS tokens_out, round(sum(amount), 4) AS cost, CAST(grouping(tool, CAST(ts AS DATE)) AS BIGINT) AS level
        FROM s GROUP BY GROUPING SETS ((tool), (CAST(ts AS DATE)), ())""",
    ),
    "cost_estimates": (
        _estimates,
        f"""WITH {STREAM}, p(model, i, o) AS (VALUES {', '.join(map(str, PRICES))}), r AS (SELECT tool AS model, count(*) AS calls, sum(k)::DOUBLE AS ti, sum(k * 3)::DOUBLE AS t2 FROM s GROUP BY 1),
        x AS (SELECT r.model, calls, calls * (ti / 1e6 * coalesce(i, 1.0)::DOUBLE + t2 / 1e6 * coalesce(o, 5.0)::DOUBLE) AS mid FROM r LEFT JOIN p ON p.model = r.model) SELECT model, calls, round(mid * 0.5, 4) AS low, round(mid, 4) AS mid, round(mid * 2, 4) AS high FROM x""",
    ),
    "key_snippets": (
        lambda s, d: o.snippets(table(s, d, "documents"), "source", 3),
        """WITH f AS (SELECT source, substr(text, 1, 80) AS p, min(doc_id) AS doc_id, arg_min(substr(text, 1, 200), doc_id) AS snippet FROM documents WHERE trim(text) <> '' GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM f) SELECT source, doc_id, snippet, rank FROM r WHERE rank <= 3""",
    ),
    "type_analysis": (
        lambda s, d: o.type_analysis(table(s, d, "documents"), "lang", "source"),
        """WITH e AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS i FROM e)
        SELECT lang, CAST(sum(n) AS BIGINT) AS n, count(*) AS tools, string_agg(source, ',' ORDER BY i) FILTER (WHERE i <= 3) AS top FROM r GROUP BY 1""",
    ),
    "text_validators": (
        lambda s, d: o.validated(dialogue(s, d), "content", BANNED).select("session_id", "idx", "present", "sentences", "clean", "valid"),
        rf"""WITH {DIALOGUE}, x AS (SELECT session_id, idx, regexp_matches(content, '\S') AS present, CAST(len(list_filter(regexp_split_to_array(content, '[.!?]+'), lambda q: regexp_matches(q, '\S'))) AS BIGINT) AS sentences, NOT regexp_matches(lower(content), '{'|'.join(BANNED)}') AS clean FROM m)
        SELECT *, present AND sentences <= 3 AND clean AS valid FROM x""",
    ),
    "slug_remap": (
        lambda s, d: o.slug_remap(table(s, d, "orders").select(F.col("o_orderpriority").alias("slug"), F.col("o_custkey").alias("member")), table(s, d, "orders").select(F.col("o_orderstatus").alias("slug"), F.col("o_custkey").alias("member"))),
        """WITH a AS (SELECT DISTINCT o_orderpriority AS slug, o_custkey AS m FROM orders), b AS (SELECT DISTINCT o_orderstatus AS slug, o_custkey AS m FROM orders),
        i AS (SELECT a.slug, b.slug AS t, count(*) AS n FROM a JOIN b ON a.m = b.m GROUP BY 1, 2), j AS (SELECT slug, t, n::DOUBLE / ((SELECT count(*) FROM a WHERE a.slug = i.slug) + (SELECT count(*) FROM b WHERE b.slug = i.t) - n) AS jac FROM i),
        r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY jac DESC, t DESC) AS k FROM j WHERE jac >= 0.5) SELECT s.slug, r.t AS "to", round(r.jac, 6) AS jaccard FROM (SELECT DISTINCT slug FROM a) s LEFT JOIN r ON r.slug = s.slug AND k = 1""",
    ),
    "sync_drift": (
        lambda s, d: o.synced(tool_stream(s, d).select("id", F.col("tool").alias("platform")), tool_stream(s, d).where("amount > 5"), "id"),
        f"WITH {STREAM} SELECT tool AS platform, count(*) AS source_rows, count(*) FILTER (WHERE amount > 5) AS canonical_rows, round((count(*) - count(*) FILTER (WHERE amount > 5))::DOUBLE / count(*), 6) AS drift FROM s GROUP BY 1",
    ),
    "grade_changes": (
        _grades,
        """WITH x AS (SELECT o_custkey AS id, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-12-01') AS days, min(o_orderpriority) AS p FROM orders GROUP BY 1),
        y AS (SELECT id, CASE p WHEN '1-URGENT' THEN 'established' WHEN '2-HIGH' THEN 'dead' END AS grade, CASE WHEN days > 30 THEN 'dead' WHEN days > 7 THEN 'declining' ELSE 'established' END AS new_grade FROM x) SELECT * FROM y WHERE grade IS DISTINCT FROM new_grade""",
    ),
    "candidate_priority": (
        _candidates,
        """WITH r AS (SELECT l_partkey AS id, count(*)::DOUBLE AS n, count(DISTINCT l_suppkey)::DOUBLE AS se, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE / count(*) AS rate, count(*) FILTER (WHERE l_quantity > 45) AS fl, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE / count(*) AS ts, count(*) FILTER (WHERE l_discount > 0.05::DOUBLE)::DOUBLE / count(*) AS rs FROM lineitem GROUP BY 1),
        c AS (SELECT id, CASE WHEN fl > 0 THEN 'workflow' WHEN ts >= 0.8 THEN 'tool' WHEN rs >= 0.7 THEN 'repo' ELSE 'general' END AS kind, round(least(n / 20, 0.4::DOUBLE) + least(se / 10, 0.3::DOUBLE) + least(rate * 0.3::DOUBLE, 0.3::DOUBLE), 3) AS confidence FROM r)
        SELECT *, CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS priority FROM c""",
    ),
    "last_session_trend": (
        lambda s, d: o.last_sessions(tool_stream(s, d), "k"),
        f"""WITH {STREAM}, e AS (SELECT k, session_id, max(ts) AS t, count(*) FILTER (WHERE is_error) AS n FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, session_id DESC) AS i FROM e)
        SELECT k, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY i DESC) AS trend FROM r WHERE i <= 5 GROUP BY 1""",
    ),
    "diverse_examples": (
        lambda s, d: o.diversity(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("score"), F.col("embedding").alias("vec")), "label", 0.5),
        None,
    ),
}
