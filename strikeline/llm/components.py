"""Connected components by alternating large-star and small-star rounds, each a shuffle of the links left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import materialise


def _least(links: DataFrame) -> DataFrame:
    """(u, least): the smallest of u and its neighbours; u may have any number of them, as min combines before the shuffle."""
    return links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("least"))


def connect(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b), component being the smallest node reachable."""
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = materialise(large, "large_star")
        least = _least(large)
        near = large.join(least, "u")
        small = near.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        after = materialise(small.distinct(), "small_star")
        changed = after.join(links, ["u", "v"], "left_anti").limit(1).count() or links.join(after, ["u", "v"], "left_anti").limit(1).count()
        links = after
        if not changed:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
