"""Queries over similarity, datasets, health, rules and drill-down."""

from pyspark.sql import functions as F

from sessionloom.functions import text as t
from sessionloom.operators import datasets as o
from sessionloom.operators import leader, neighbours, phrases
from sessionloom.operators import similarity as c
from sessionloom.sources.bind import DIALOGUE, STREAM, dialogue, table, tool_stream

W = "(PARTITION BY session_id ORDER BY ts, id)"
STOP = ("the", "and", "that", "for", "with", "this", "was", "are")
TERMS = ("idiot", "license", "tion", "password")
RULES = (("quiet", ("idiot", "moron", "loser", "trash")), ("law", ("license", "rights", "reserved", "released")), ("none", ("zebra", "quagga")))
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
V = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def _rules(s):
    return s.createDataFrame([(n, list(x)) for n, x in RULES], "rule string, terms array<string>")


def _facts(s, d):
    facts = table(s, d, "orders").select(F.col("o_orderkey").alias("error_id"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_orderdate").cast("string").alias("day"))
    return o.dataset_counts(table(s, d, "lineitem").select((F.col("l_partkey") % 97).alias("pattern_id"), F.col("l_orderkey").alias("error_id")).dropDuplicates(), facts)


def _near_texts(s, d):
    """Each document with its class of equal vectors and the number of documents that it is near to."""
    docs = table(s, d, "documents")
    linked = neighbours.near_links(neighbours.text_vectors(docs, "doc_id", "text"))
    return docs.select("doc_id").join(linked, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


QUERIES = {
    "signature_groups": (
        lambda s, d: c.signature_groups(table(s, d, "documents")),
        f"""WITH e AS (SELECT *, substr(sha256({t.normalised_sql('text')}), 1, 16) AS signature FROM documents), k AS (SELECT signature, lang, count(*) AS n FROM e GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY n DESC, lang) AS i FROM k), p AS (SELECT signature, string_agg(lang, ',' ORDER BY i) AS top FROM r WHERE i <= 3 GROUP BY 1)
        SELECT e.signature, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id, max(doc_id) AS last_id, min(top) AS top FROM e JOIN p ON p.signature = e.signature GROUP BY 1 HAVING count(*) >= 2""",
    ),
    "cosine_topk": (
        lambda s, d: c.cosine_topk(_vectors(s, d), _vectors(s, d).where("id % 100 = 0"), 10, 0.1),
        f"WITH {V}, x AS (SELECT b.id AS query_id, a.id, {COS} AS sc FROM v a, v b WHERE b.id % 100 = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS rank FROM x) SELECT query_id, id, rank, round(sc, 5) AS score FROM r WHERE rank <= 10 AND sc >= 0.1",
    ),
    "duplicate_vector_pairs": (
        lambda s, d: c.duplicate_pairs(_vectors(s, d), "label", 0.3),
        f"WITH {V} SELECT a.id AS a, b.id AS b, round({COS}, 5) AS score FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE {COS} >= 0.3",
    ),
    "duplicate_vector_pairs_all": (
        lambda s, d: c.all_duplicate_pairs(_vectors(s, d), 0.3),
        f"""WITH {V}, u AS (SELECT v, min(id) AS id, count(*) AS copies FROM v GROUP BY v) SELECT a.id AS a, b.id AS b, a.copies AS copies_a, b.copies AS copies_b, round({COS}, 5) AS score, false AS equal FROM u a JOIN u b ON a.id < b.id WHERE {COS} >= 0.3
        UNION ALL SELECT u.id, v.id, u.copies, u.copies, 1.0, true FROM v JOIN u ON u.v = v.v WHERE v.id <> u.id""",
    ),
    "near_text_vectors": (_near_texts, None),
    "cluster_summary_by_label": (
        lambda s, d: _vectors(s, d).groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.round(F.avg(F.col("vec")[0].cast("double")), 5).alias("mean0")),
        f"WITH {V} SELECT label, count(*) AS n, min(id) AS first_id, max(id) AS last_id, round(avg(v[1]), 5) AS mean0 FROM v GROUP BY 1",
    ),
    "greedy_clusters": (lambda s, d: leader.leader_clusters(_vectors(s, d), 0.8), None),
    "jaccard_pairs": (
        lambda s, d: c.jaccard_pairs(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name")), 0.4),
        """WITH q AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z]+'), lambda x: x <> ''))) AS tok FROM part),
        p AS (SELECT tok, min(id) AS id, count(*) AS names FROM q WHERE len(tok) > 0 GROUP BY 1), j AS (SELECT a.id AS a, b.id AS b, a.names AS names_a, b.names AS names_b, len(list_intersect(a.tok, b.tok))::DOUBLE AS i, len(list_distinct(list_concat(a.tok, b.tok))) AS u FROM p a JOIN p b ON a.id < b.id)
        SELECT a, b, names_a, names_b, round(i / u, 6) AS jaccard FROM j WHERE i >= 0.4 * u""",
    ),
    "keyword_search_topk": (
        lambda s, d: c.keyword_search(table(s, d, "documents"), list(TERMS), 20),
        "WITH x AS (SELECT doc_id, round((" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in TERMS) + f") / {len(TERMS)}.0::DOUBLE, 6) AS score FROM documents) SELECT * FROM x WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20",
    ),
    "hop2_filter": (
        lambda s, d: c.refine(table(s, d, "documents"), ["text", "source"], ["worthless", "src7"]).select("doc_id"),
        "SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'src7') OR contains(lower(source), 'worthless') OR contains(lower(source), 'src7')",
    ),
    "phrase_mining": (
        lambda s, d: phrases.phrases(table(s, d, "documents"), "lang", STOP),
        f"""WITH d AS (SELECT lang, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[{t.LETTERS}]+'), lambda w: length(w) > 2 AND w NOT IN {STOP}) AS w FROM documents),
        g AS (SELECT lang, 3 AS size, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS phrase FROM d UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM d),
        a AS (SELECT lang, size, phrase, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY size DESC, n DESC, phrase) AS rank FROM a) SELECT * FROM r WHERE rank <= 5""",
    ),
    "recovery_next_row": (
        lambda s, d: o.recoveries(tool_stream(s, d)),
        f"""WITH {STREAM}, x AS (SELECT *, first_value(CASE WHEN NOT is_error THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM s)
        SELECT x.id, x.session_id, next_id, n.tool AS next_tool FROM x JOIN s n ON n.id = next_id WHERE x.is_error""",
    ),
    "curate_semi_range": (
        lambda s, d: o.followed_within(tool_stream(s, d), F.col("is_error"), F.col("tool") == "purchase", 21600).select("id"),
        f"WITH {STREAM} SELECT id FROM s a WHERE is_error AND EXISTS (SELECT 1 FROM s b WHERE b.session_id = a.session_id AND b.tool = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR)",
    ),
    "positive_error_pairs": (
        lambda s, d: o.preceded_pairs(tool_stream(s, d), F.col("is_error"), F.col("tool") == "signup", 21600),
        f"WITH {STREAM} SELECT a.id AS error_id, b.id AS good_id FROM s a JOIN s b ON b.session_id = a.session_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 6 HOUR WHERE a.is_error AND b.tool = 'signup'",
    ),
    "skill_health": (
        lambda s, d: o.skill_health(tool_stream(s, d).withColumn("satisfied", F.when(F.col("k") % 4 != 0, F.col("k") % 3 != 0))),
        f"""WITH {STREAM}, x AS (SELECT tool, CASE WHEN k % 4 <> 0 THEN k % 3 <> 0 END AS ok FROM s), a AS (SELECT tool, count(*) AS total, count(*) FILTER (WHERE ok) AS satisfied, count(*) FILTER (WHERE NOT ok) AS unsatisfied, count(*) FILTER (WHERE ok IS NULL) AS unlabelled FROM x GROUP BY 1),
        b AS (SELECT *, round(satisfied::DOUBLE / nullif(satisfied + unsatisfied, 0), 6) AS rate FROM a) SELECT *, coalesce(rate < 0.5, false) AS flagged FROM b""",
    ),
    "failure_surface": (
        lambda s, d: o.failure_surface(tool_stream(s, d), "k"),
        f"WITH {STREAM}, u AS (SELECT DISTINCT k, session_id FROM s WHERE is_error), l AS (SELECT k, string_agg(CAST(session_id AS VARCHAR), ',' ORDER BY session_id) AS sessions, count(*) AS n_sessions FROM u GROUP BY 1) SELECT s.k, count(*) AS failures, min(sessions) AS sessions, min(n_sessions) AS n_sessions FROM s JOIN l ON l.k = s.k WHERE is_error GROUP BY 1 HAVING min(n_sessions) >= 3",
    ),
    "label_skew": (
        lambda s, d: o.label_skew(table(s, d, "labels"), "quality"),
        "WITH a AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), b AS (SELECT *, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM a) SELECT *, share > 0.9 AS skewed FROM b",
    ),
    "retention_antijoin": (
        lambda s, d: o.purged(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day")), "o_orderkey", "day", "1995-01-01", table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))),
        "WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders) SELECT o_orderkey, day FROM q WHERE NOT (day < '1995-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45))",
    ),
    "search_discipline": (
        lambda s, d: o.discipline(tool_stream(s, d), {"recent": F.col("k") < 30, "multi": F.col("k") % 10 == 0, "context": F.col("amount") > 20}),
        f"WITH {STREAM} SELECT tool, count(*) AS n, round(avg(CAST(coalesce(k < 30, false) AS INTEGER)), 6) AS recent, round(avg(CAST(coalesce(k % 10 = 0, false) AS INTEGER)), 6) AS multi, round(avg(CAST(coalesce(amount > 20, false) AS INTEGER)), 6) AS context FROM s GROUP BY 1",
    ),
    "rule_violations": (
        lambda s, d: o.violations(table(s, d, "documents"), _rules(s)),
        "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-zà-ÿ]+')) AS term FROM documents), r(rule, term) AS (VALUES " + ", ".join(f"('{n}', '{x}')" for n, xs in RULES for x in xs) + """),
        h AS (SELECT rule, doc_id, count(*) AS n FROM w JOIN r USING (term) GROUP BY 1, 2 HAVING count(*) >= 2), a AS (SELECT rule, count(*) AS violations, max(doc_id) AS last FROM h GROUP BY 1)
        SELECT x.rule, coalesce(violations, 0) AS violations, last, violations IS NULL AS compliant FROM (SELECT DISTINCT rule FROM r) x LEFT JOIN a ON a.rule = x.rule""",
    ),
    "detection_replay": (
        lambda s, d: o.replay(tool_stream(s, d), "array_contains(history, 'error') and size(history) >= 3"),
        f"""WITH {STREAM}, x AS (SELECT *, list(tool) OVER (PARTITION BY session_id ORDER BY ts, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM s), f AS (SELECT *, coalesce(list_contains(h, 'error') AND len(h) >= 3, false) AS fires FROM x)
        SELECT session_id, count(*) FILTER (WHERE is_error) AS errors, count(*) FILTER (WHERE is_error AND fires) AS caught, count(*) FILTER (WHERE NOT is_error AND fires) AS false_alarms FROM f GROUP BY 1""",
    ),
    "winning_path": (
        lambda s, d: o.winning_path(tool_stream(s, d)).select("id", "session_id", "step", "phase"),
        f"""WITH {STREAM}, a AS (SELECT *, coalesce(lag(tool) OVER {W} = tool AND lag(k) OVER {W} = k, false) AS again FROM s WHERE NOT is_error), b AS (SELECT *, row_number() OVER {W} AS step, count(*) OVER (PARTITION BY session_id) AS n FROM a WHERE NOT again)
        SELECT id, session_id, step, CASE WHEN (step - 1)::DOUBLE / n < 0.3 THEN 'explore' WHEN (step - 1)::DOUBLE / n < 0.8 THEN 'implement' ELSE 'verify' END AS phase FROM b""",
    ),
    "struggle_fix": (
        lambda s, d: o.fixes(tool_stream(s, d)),
        f"""WITH {STREAM}, n AS (SELECT *, row_number() OVER {W} AS i FROM s), j AS (SELECT a.id, a.session_id, b.id AS bid, row_number() OVER (PARTITION BY a.id ORDER BY b.i) AS r FROM n a JOIN n b ON a.session_id = b.session_id AND b.i BETWEEN a.i + 1 AND a.i + 3 AND NOT b.is_error AND abs(b.k - a.k) <= 10 WHERE a.is_error)
        SELECT id, session_id, bid AS fix_id FROM j WHERE r = 1""",
    ),
    "topic_filter_neighbours": (
        lambda s, d: o.topic_with_neighbours(dialogue(s, d), "(?i)ther").select("session_id", "idx", "step"),
        f"WITH {DIALOGUE}, a AS (SELECT *, coalesce(regexp_matches(content, '(?i)ther'), false) AS hit FROM m), b AS (SELECT *, max(hit) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM a) SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS step FROM b WHERE near",
    ),
    "context_window_pm2": (
        lambda s, d: o.windows_around(dialogue(s, d), "(?i)tion"),
        f"WITH {DIALOGUE}, h AS (SELECT session_id, idx AS hit_idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS r FROM m WHERE regexp_matches(content, '(?i)tion')) SELECT m.session_id, hit_idx, idx, role FROM m JOIN h ON h.session_id = m.session_id AND idx BETWEEN hit_idx - 2 AND hit_idx + 2 WHERE r <= 5",
    ),
    "skeleton_per_session": (
        lambda s, d: o.skeleton(dialogue(s, d), "(?i)the"),
        f"WITH {DIALOGUE} SELECT session_id, count(*) AS hits, max(idx) AS last_idx, arg_max(substr(content, 1, 80), idx) AS snippet FROM m WHERE regexp_matches(content, '(?i)the') GROUP BY 1",
    ),
    "dataset_counts": (
        _facts,
        """WITH b AS (SELECT DISTINCT l_partkey % 97 AS pattern_id, l_orderkey AS error_id FROM lineitem) SELECT pattern_id, count(*) AS examples, CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS positive, CAST(min(o_orderdate) AS VARCHAR) AS first, CAST(max(o_orderdate) AS VARCHAR) AS last
        FROM b JOIN orders ON o_orderkey = error_id GROUP BY 1 HAVING count(*) >= 5""",
    ),
    "distributions_grouping_sets": (
        lambda s, d: o.distributions(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
        "SELECT 'o_orderstatus' AS dimension, o_orderstatus AS entry, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY 2",
    ),
    "union_sources_latest": (
        lambda s, d: o.latest_per_source({"calls": tool_stream(s, d).select("session_id", F.col("id").alias("at"), F.col("tool").alias("body")), "talk": dialogue(s, d).select("session_id", F.col("idx").alias("at"), F.col("role").alias("body"))}, 50),
        f"""WITH {STREAM}, {DIALOGUE}, u AS (SELECT 'calls' AS source, CAST(session_id AS VARCHAR) AS session_id, id AS "at", tool AS body FROM s UNION ALL SELECT 'talk', CAST(session_id AS VARCHAR), idx, role FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, session_id, body) AS rank FROM u) SELECT * FROM r WHERE rank <= 50""",
    ),
}
