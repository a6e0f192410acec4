"""Connected components of an edge list, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import dropped, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node of the component.

    Each round is two aggregations and two joins over the edges; it stops when
    a round changes nothing.  Every round's edges are written to the shared
    folder, so a lost executor costs one round at most; those of the round before are deleted.  Null ends and loops
    are left out; nodes without an edge do not appear.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    over: list[str] = []
    e = stored(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", over)
    mark = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, over = over, []
        e = stored(tied.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", over)
        dropped(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
