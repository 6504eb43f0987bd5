"""Pairs from classes: every pair, in blocks where a class is large, or a star for large classes if that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.operators.skew import with_key_totals
from chunkwright.session import checkpointed

#: Classes of more rows are paired in blocks of about this many, spread over tasks.
BLOCK = 1000


def class_pairs(members: DataFrame, key: str, class_id: str = "class_id", differ: str | None = None, max_full: int | None = None) -> DataFrame:
    """Pairs ``key_a < key_b`` inside classes, of different ``differ`` if that is given.

    Every pair comes out, quadratic in a class's rows; every two blocks of a large class
    meet under a join key of their own. With ``max_full``, a class of more rows gives a
    star: each row paired with the class's smallest row (with ``differ``, the rows that
    agree with that one with the smallest row that differs, and the smallest rows of every
    two variants with each other). Rows with a null class don't pair; repeated keys count
    once. The members are checkpointed: they are read several times here, and what made
    them must not run as often.
    """
    rows = checkpointed(members.where(F.col(class_id).isNotNull()).select(F.col(key).alias("_k"), F.col(class_id).alias("_c"), (F.col(differ) if differ else F.col(key)).alias("_v"))).distinct()
    sized = with_key_totals(rows, ["_c"], "_k", {"_n": F.lit(1)}).where("_n > 1")
    pairs = _all_pairs(sized if max_full is None else sized.where(F.col("_n") <= max_full))
    if max_full is not None:
        large = sized.where(F.col("_n") > max_full).drop("_n")
        by_variant = large.groupBy("_c", "_v").agg(F.min("_k").alias("_first"))
        heads = by_variant.groupBy("_c").agg(F.min_by("_v", "_first").alias("_v1"), F.min("_first").alias("_k1"))
        second = by_variant.join(heads, "_c").where("_v != _v1").groupBy("_c").agg(F.min("_first").alias("_k2"))
        starred = large.join(heads.join(second, "_c"), "_c").select("_k", F.when(F.col("_v") != F.col("_v1"), F.col("_k1")).otherwise(F.col("_k2")).alias("_hub"))
        star = starred.select(F.least("_k", "_hub").alias("_ka"), F.greatest("_k", "_hub").alias("_kb"))
        if differ:
            firsts = with_key_totals(by_variant.select(F.col("_first").alias("_k"), "_c", "_v"), ["_c"], "_k", {"_n": F.lit(1)})
            star = star.unionByName(_all_pairs(firsts))
        pairs = pairs.unionByName(star.distinct())
    return pairs.select(F.col("_ka").alias(f"{key}_a"), F.col("_kb").alias(f"{key}_b"))


def _all_pairs(sized: DataFrame) -> DataFrame:
    """(_ka, _kb): the pairs of (_k, _c, _v, _n) in each class of _n rows whose _v differ. A row is in one block and goes to as many joins as its class has blocks."""
    dealt = sized.withColumn("_g", F.ceil(F.col("_n") / BLOCK).cast("int")).withColumn("_of", F.pmod(F.xxhash64("_k"), F.col("_g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    a = dealt.select("_c", F.col("_of").alias("_i"), other.alias("_j"), F.col("_k").alias("_ka"), F.col("_v").alias("_va"))
    b = dealt.select("_c", other.alias("_i"), F.col("_of").alias("_j"), F.col("_k").alias("_kb"), F.col("_v").alias("_vb"))
    return a.join(b, ["_c", "_i", "_j"]).where((F.col("_ka") < F.col("_kb")) & (F.col("_va") != F.col("_vb"))).select("_ka", "_kb")


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
