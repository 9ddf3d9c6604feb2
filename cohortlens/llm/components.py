"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join of
the edges with it; the edges side may be skewed, which adaptive execution
splits. Edges are kept in the shared folder between steps. The steps end
when the edge set no longer changes: then every node has one edge, to the
smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.scratch import keep


def components(edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges`` (a, b); rows with a null or a = b add nothing.

    Returns (node, root) for every node with an edge to another, root being
    the smallest node reachable. An empty edge table gives no row.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = keep(e)
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = keep(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
