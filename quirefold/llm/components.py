"""Connected components over written edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node with an edge (a, b); one row a node.

    Each step moves edges towards smaller nodes and keeps the components; it ends when nothing moves, after about
    log(longest path) steps. A node with very many edges is one skewed join key, which adaptive execution splits, and
    a minimum, which is pre-aggregated.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo").distinct())
        before = seen
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, e = e, stored(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        discard(last)
