"""Connected components of an edge table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or, with itself, not larger) neighbours to the least of its neighbourhood.

    Every group is reduced by a pre-aggregated minimum and joined back, never collected, so a hub with
    a third of all nodes is a skewed join that adaptive execution splits.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v of one ordered type); root is the least node reachable.

    Self loops and repeated edges have no effect; an edge with a null end is ignored; an empty table gives
    an empty one. Raises when `most` rounds do not suffice (each halves the longest path at least).
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    for _ in range(most):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if tuple(now) == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(now)
        edges = checkpointed(_star(_star(edges, True), False))
    raise RuntimeError(f"components did not settle in {most} rounds")
