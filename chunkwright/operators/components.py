"""Connected components of a graph of any size, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.session import checkpointed


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, component): each node of ``edges`` with the smallest node it is linked to.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until no edge
    changes. Neighbours are never collected: a step joins each edge with the minimum of its
    node's neighbourhood, which is combined before it moves. Nulls and loops are left out;
    an empty graph has no nodes.
    """
    pairs = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} != {b}")
    now = checkpointed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
        after = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first() == now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
