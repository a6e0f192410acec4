"""Mixing sources to target weights with repetition rates.

Words are summed per source; targets share the corpus by weight, stop at a
multiple of the source and pass the excess on; a document is taken
floor(rate) times, and once more with a hash-seeded Bernoulli draw of the
fraction.  All in DataFrame operations; only one row per source meets in the
window that deals the weights.

Defined cases: null texts have size 0; the null source comes last; the draw
depends on id and text alone, so reruns agree and repeated rows agree; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import table, words


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) -> + target, by water-filling in closed form.

    Sources are ordered by the level at which they are full (cap over weight).
    The level of the rest is what the full ones leave, over the weight left;
    the first source not full at that level fixes it.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    by_level = Window.orderBy("_full", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("_n", F.row_number().over(order) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", F.col("source_size").cast("double") * most).withColumn("_full", F.col("_cap") / F.col("_w"))
    s = s.withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.col("_used")) / F.col("_left"))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_level"))).over(every)["_level"])
    return s.select("source", "source_size", F.least("_cap", F.coalesce("_level", F.lit(0.0)) * F.col("_w")).alias("target"))


def copies(rate: Column, *key: Column) -> Column:
    """floor(rate), plus one with the fraction's probability by a hash of the key."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 12), 16, 10).cast("double") / float(16**12)
    whole = F.floor(rate)
    return whole + F.when(draw < rate - whole, 1).otherwise(0)


def repeated(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The documents, columns unchanged, each as often as the mix takes it."""
    d = docs.withColumn("_size", F.size(words(F.col("text"))).cast("long"))
    dealt = targets(d.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    rates = dealt.select(F.col("source").alias("_source"), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("_rate"))
    out = docs.join(rates, docs["source"].eqNullSafe(F.col("_source")))
    times = copies(F.col("_rate"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"], F.lit("")))).cast("int")
    return out.withColumn("_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*[docs[c] for c in docs.columns])


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs(doc_id, text, source) -> every row's size, source_size, target, taken.  The texts do not take part in the join."""
    d = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("_digest"))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = targets(sizes, weights, most).select(F.col("source").alias("_source"), "source_size", "target")
    out = d.join(dealt, d["source"].eqNullSafe(F.col("_source")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    taken = copies(rate, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_digest")) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(n % 3) + 1] AS DOUBLE) AS wt, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / wt AS ful FROM w),
u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ful, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
       sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY ful, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
       sum(source_size) OVER () AS total FROM f),
l AS (SELECT *, (total - used) / rest AS lev FROM u),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, ful) FROM l WHERE lev <= ful), 0) * wt) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0) AS rate,
       CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || d.digest), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
