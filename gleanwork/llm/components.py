"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node of its component.

    After Kiveris et al. (2014): each step points nodes at the smallest neighbour, until the links
    are stars. Steps are a partial aggregation and a join; each round's links are written to the
    shared folder, so that lineage stays short and a lost executor costs one step. Links only ever move to
    smaller nodes, so rounds end; their number grows with the logarithm of the longest path.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        # Large star: the larger neighbours of each node move to its smallest neighbour (or itself).
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        # Small star: the smaller neighbours of each node, and itself, move to the smallest.
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        fresh = cut(moved.filter("u <> v").distinct(), "links")
        for old in (edges, least, large, low):
            drop_cut(old)
        edges = fresh
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
