"""Connected components of edge tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Any number; joins by a mix of a key can be split where the key's own partitioning can't.
MIX = 0x5DEECE66D


def _star(links: DataFrame) -> DataFrame:
    """(u, v, m): every link with m, the least of u and its neighbours.

    The least is summed up before the shuffle. The join back is by a mix of u, which deals both sides anew, so that adaptive execution can split a hub's links over tasks; the sums' own partitioning would bind them to one.
    """
    mixed = F.col("u").bitwiseXOR(F.lit(MIX)).alias("__mix")
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(mixed, F.least("u", "m").alias("m"))
    return links.select("u", "v", mixed).join(least, "__mix").select("u", "v", "m")


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node with an edge, the least node that can be reached.

    Edges join columns a and b of type long; loops and repeated edges are no matter, edges with a null are dropped. A node without edges has no row. An empty table gives an empty one.
    Each round keeps at most as many edges as there were, and the rounds grow with the logarithm of the largest component. Every round is checkpointed.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to the least neighbour of u.
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its neighbours below it go to the least of them.
        star = _star(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        links = checkpointed(small.where("u <> v").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
