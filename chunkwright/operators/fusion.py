"""Hybrid search: branch budgets and reciprocal rank fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.vector import RRF_K, reciprocal_rank


def branch_budgets(k: int, dense_weight: float) -> tuple[int, int]:
    """How many candidates the dense and the sparse branch give: 4 k shared by weight, k at least, in single precision and truncated."""
    dense = np.float32(dense_weight)
    sparse = np.float32(1) - dense
    total = np.float32(k * 4)
    share = lambda w: max(k, int(total * w / (dense + sparse)))
    return share(dense), share(sparse)


def fuse(*branches: DataFrame, by: str, key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(``by``, ``key``, score, rank): ranked lists fused by the sum of 1 / (rrf_k + rank), the best ``k`` of each ``by``; ties by key."""
    lists = branches[0].select(by, key, "rank")
    for branch in branches[1:]:
        lists = lists.unionByName(branch.select(by, key, "rank"))
    scored = lists.groupBy(by, key).agg(F.round(F.sum(reciprocal_rank(F.col("rank"), rrf_k)), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc(key)))).where(F.col("rank") <= k)
