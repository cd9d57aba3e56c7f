"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every node learns the least node it can reach.  A round is two aggregations and two
joins on node keys; hot nodes are pre-aggregated by the partial minimum and their join
partitions are split by adaptive execution.  Each round's edges are kept in the shared
checkpoint folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import saved


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (node, lower) with node > lower."""
    both = edges.select("node", "lower").union(edges.select(F.col("lower").alias("node"), F.col("node").alias("lower")))
    least = both.groupBy("node").agg(F.min("lower").alias("other")).select("node", F.least("node", "other").alias("least"))
    large = both.where("lower > node").join(least, "node").select(F.col("lower").alias("node"), F.col("least").alias("lower")).distinct()
    # a node that is its own least keeps no lower neighbour, and its higher ones point at it
    least = large.groupBy("node").agg(F.min("lower").alias("least"))
    moved = large.join(least, "node").where("lower <> least").select(F.col("lower").alias("node"), F.col("least").alias("lower"))
    return moved.union(least.select("node", F.col("least").alias("lower"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "lower"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: for every node of an edge that joins two different nodes, the
    least node of its component; a root has no row of its own.  Null ends and loops are
    ignored, repeated edges count once, no edges give no rows.
    """
    now = saved(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("node"), F.least(a, b).alias("lower")).distinct()
    )
    last = None
    while last != (last := _digest(now)):
        now = saved(_stars(now))
    return now.select("node", F.col("lower").alias("root"))
