"""Quality rules by cross-document line frequency, in DataFrame operations only.

Lines are normalised (trimmed, lower-cased) and hashed; per host the number of
different documents that hold a line is counted.  Lines above both limits are
removed, and a document that loses too much of itself is rejected as depleted.

Defined cases: a null text has no words (``base_failed``); a null host is a
host of its own; documents with equal texts count once per host, so copies do
not make their own lines frequent; repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.common import SPACES, SPACE_RUN, table, words


def with_base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated 5-word windows: windows are hashed; only a document whose hashes
    are not all distinct sorts them and adds up the words that they cover.
    """
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t")))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]", ""))).cast("long"))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    at = lambda i: F.get("_h", i)
    d = d.withColumn(
        "_g",
        F.when(F.size("_h") >= 6, F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 4, F.lit(0))), lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2), at(i + 3), at(i + 4)))),
    )
    d = d.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda e, o: F.coalesce(e["h"] == o["h"], F.lit(False))
    d = d.withColumn(
        "_p",
        F.sort_array(F.transform(F.filter("_s", lambda e, i: same(e, F.get("_s", i - 1)) | same(e, F.get("_s", i + 1))), lambda e: e["i"])),
    )
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.lit(5), F.coalesce(F.get("_p", i + 1) - x, F.lit(5)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return d.drop("_t", "_w", "_l", "_h", "_g", "_s", "_p")


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_docs: int = 10,
    line_share: float = 0.01,
    removed_share: float = 0.5,
    min_words: int = 10,
) -> DataFrame:
    """One row per document: measures, words removed with frequent lines, verdict.

    A line goes where more than ``line_docs`` different documents of its host,
    and more than ``line_share`` of them, hold it.  A document is depleted if
    over ``removed_share`` of its words go or under ``min_words`` remain.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(host).isNull(), F.col(host)).alias("_host"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_doc"),
    )
    line = F.btrim(F.col("line"), F.lit(SPACES))
    lines = (
        d.select("_host", "_doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(line != "")
        .select("_host", "_doc", "pos", F.xxhash64(F.lower(line)).alias("_line"), F.size(F.split(line, SPACE_RUN)).alias("w"))
        .distinct()
    )
    hosts = d.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("docs"))
    frequent = (
        lines.select("_host", "_line", "_doc").distinct().groupBy("_host", "_line").agg(F.count("*").alias("n")).where(F.col("n") > line_docs)
        .join(hosts, "_host").where(F.col("n") > F.col("docs") * F.lit(line_share)).select("_host", "_line")
    )
    lost = lines.join(frequent, ["_host", "_line"], "left_semi").groupBy("_host", "_doc").agg(F.sum("w").alias("removed_words"))
    out = with_base_measures(d).drop("text").join(lost, ["_host", "_doc"], "left")
    gone = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    bad = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (gone <= removed_share * F.col("n_words")) & (F.col("n_words") - gone >= min_words)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        bad.alias("base_failed"), (~bad & fine).alias("kept"), gone.alias("removed_words"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('s' || source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, host, t, lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS line,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k FROM (SELECT doc_id, host, t, unnest(ls) AS line FROM w)),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
freq AS (SELECT f.host, f.line FROM (SELECT host, line, count(DISTINCT t) AS n FROM ln GROUP BY host, line) f JOIN hosts h ON h.host = f.host
         WHERE f.n > 10 AND f.n > h.docs * 0.01),
gone AS (SELECT doc_id, sum(k) AS n FROM ln SEMI JOIN freq ON freq.host = ln.host AND freq.line = ln.line GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND removed_words <= 0.5 * n_words AND n_words - removed_words >= 10) AS kept, removed_words FROM b
"""
