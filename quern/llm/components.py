"""Connected components by alternating large-star and small-star rounds, each a distributed aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one lower neighbour, which has none itself: then each component is a star."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    by_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return by_node.where("ups > 1 or (ups = 1 and down = 1)").isEmpty()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least reachable node) of every node of an edge list of longs.

    Repeated edges are one, an edge from a node to itself is ignored, and nodes without another edge are not returned.
    Rounds go on until every component is a star around its least node; their number grows with the logarithm of the
    longest path.
    """
    x, y = F.col(a), F.col(b)
    pairs = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while not _settled(pairs):
        # large star: the neighbours above a node go to the least node around it, itself included
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(small.where("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
