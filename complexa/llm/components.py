"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import release, work_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of long); component is the smallest node.

    Each step is two equi-joins with pre-aggregated minima; the edge table is
    written after every round, so a lost executor costs one round at most.
    Null ends are ignored; an empty edge table gives an empty result.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    e = work_table(edges.filter("a is not null and b is not null and a <> b").select(high, low).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: join every larger neighbour to the smallest node around
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: join every smaller neighbour, and the node itself, to the smallest
        met = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
        e, last = work_table(small.filter("a <> b").distinct(), "edges"), e
        release(last)
        # done when every node has one edge and no center has an edge to a smaller one: stars only
        ends = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).unionByName(e.select(F.col("b").alias("a")).distinct().withColumn("n", F.lit(1).cast("long")))
        if ends.groupBy("a").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
            break
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
