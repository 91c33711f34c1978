"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsight.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    Alternates the large-star and the small-star step: every neighbour of a node is hung below the
    smallest one. The links shrink to one per node, in a number of rounds that grows with the logarithm
    of the longest path. Each round is a table in the shared folder. Links from a node to itself and
    rows with nulls count for nothing; an empty table gives an empty one.
    """
    a, b = F.col("a"), F.col("b")
    links = links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before = cut_lineage(links), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = tuple(state)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The smallest neighbours are a table of their own, so that a node with very many neighbours is split in the join.
        least = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        below = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(below.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
