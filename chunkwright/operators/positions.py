"""Running positions and offsets inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.session import checkpointed


def with_offsets(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column | None = None, offset: str = "offset", total: str = "total") -> DataFrame:
    """Adds the sum of ``value`` (1 if none) over the preceding rows of the group, and the group's total.

    Rows are range-partitioned by group and order, so that a group of any size is spread
    over as many tasks as its share of the rows takes; what each partition holds of each
    group is summed, and those sums (at most one for each partition and group) are
    accumulated. The partitioned rows are checkpointed between the two passes, since a
    second sampling could place the ranges elsewhere. Pass only the columns that are
    needed. ``order`` should be unique in the group; rows that tie come in any order.
    Null groups are groups.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    ranged = df.withColumn("_value", (F.lit(1) if value is None else value).cast("bigint"))
    ranged = checkpointed(ranged.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    by_part = ranged.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(*group)).alias(total))
    inside = Window.partitionBy("_part", *group).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    joined = running.join(starts, same)
    return joined.withColumn(offset, F.col("_start") + F.col("_inside")).drop("_value", "_part", "_p", "_start", "_inside", *[f"_g{i}" for i in range(len(group))])
