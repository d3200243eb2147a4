"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate with map-side combine and a join, so a hub with very many neighbours is
split by Spark's skew join; nothing but two scalars a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipcoach.plans import shared as scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """edges point from u to a smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of any orderable type, undirected; returns (node, root): root is the smallest node reachable.

    Nodes without a link are absent; a null end or a link to itself is ignored; an empty table gives an empty one.
    """
    edges = scratch.save(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        new = scratch.save(_small(_large(edges)), "edges")
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(edges)
        edges = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
