"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node that a link ``a, b`` names.

    Alternates large-star and small-star steps until every node points straight
    at the smallest node of its component. Each step is a grouped minimum, which
    combines before the shuffle, and a join that Spark may split at a hub; the
    links of a step are written before the next one reads them. Empty links give
    no rows, a link of a node with itself gives that node.
    """
    every = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    every = stored(every, "links")
    nodes = every.where("a = b").select(F.col("a").alias("node"))
    state = every.where("a <> b")
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
        )
        state = stored(small.distinct(), "small-star")
        heads = state.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        inner = state.select(F.col("b").alias("a")).distinct().join(heads, "a", "left_semi")
        chains = inner.limit(1).count() + heads.where("n > 1").limit(1).count()
        if not chains:
            break
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node")).distinct()
    alone = nodes.join(found, "node", "left_anti").join(roots, "node", "left_anti").distinct()
    return found.unionByName(roots.unionByName(alone).withColumn("component", F.col("node")))
