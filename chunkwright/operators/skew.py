"""Grouping that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Partitions over which a key is spread at least, and the part of all partitions that a key gets: no key, whatever its share, makes a partition larger than the others by more than SPREAD times its share.
SALTS = 32
SPREAD = 8
#: Bytes of a shuffle partition that ``partitions_for`` aims at, and the most partitions it gives.
PARTITION_BYTES = 64 << 20
MOST_PARTITIONS = 200_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark estimates them; what it can't tell the size of doesn't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    return sum(n for n in sizes if n < 1 << 60)


def partitions_for(df: DataFrame, growth: float = 1.0) -> int:
    """Partitions for a shuffle of ``growth`` times the bytes of the tables that ``df`` reads: the session's number, or more where that would make them larger than PARTITION_BYTES."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTITIONS, math.ceil(input_bytes(df) * growth / PARTITION_BYTES)))


def spread_if_few(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to the session's partitions by ``key`` if its tables are so small that they are read in fewer tasks than there are cores; larger ones stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = input_bytes(df) < cores * (128 << 20)
    return df.repartition(key) if few else df


def _dealt(df: DataFrame, keys: Sequence[str], spread: str, salts: int | None, partitions: int | None) -> DataFrame:
    """``df`` partitioned by keys and ``_salt``. Null keys go here: a join above would filter them out of its own branch only, and the two branches could then not share the exchange."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("_salt", salt(F.col(spread), salts or max(SALTS, n // SPREAD)))
    for c in [*keys, "_salt"]:
        salted = salted.where(F.col(c).isNotNull())
    return salted.repartition(partitions, *keys, "_salt") if partitions else salted.repartition(*keys, "_salt")


def salt(spread: Column, salts: int) -> Column:
    """A number below ``salts`` that depends on ``spread`` only, so that a retried task draws the same."""
    return F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")


def with_key_totals(df: DataFrame, keys: Sequence[str], spread: str, sums: dict[str, Column], salts: int | None = None, combine: Callable[[Column], Column] = F.sum, partitions: int | None = None) -> DataFrame:
    """Every row of ``df`` with totals over all rows of its key.

    ``sums`` maps a new column to the expression that is summed (or otherwise combined, by
    a function like F.min that may be applied to its own results). The rows are partitioned
    once, by key and salt. Each salt is summed where it lies, the few sums of a key
    (``salts`` at most) are added up, and the totals return to the same partitions, so
    neither the aggregation nor the join brings a hot key's rows together.
    Keys must not be null: rows with a null key don't come out.
    """
    salted = _dealt(df, keys, spread, salts, partitions)
    local = salted.groupBy(*keys, "_salt").agg(*[combine(e).alias(c) for c, e in sums.items()])
    whole = Window.partitionBy(*keys)
    totals = local.select(*keys, "_salt", *[combine(c).over(whole).alias(c) for c in sums])
    return salted.join(totals.hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")


def grouped_with_totals(df: DataFrame, keys: Sequence[str], member: str, aggs: dict[str, Column], sums: dict[str, Column], salts: int | None = None, partitions: int | None = None) -> DataFrame:
    """(keys, member, aggs, sums): rows grouped by key and member, each group with totals over all members of its key.

    ``aggs`` are taken over the rows of a key and member, ``sums`` are expressions over
    their results that are summed for each key. One exchange, by key and salt of the member,
    serves the grouping, the sums of each salt and the way back of the totals; only the sums
    (``salts`` at most for a key) move once more. Rows with a null key don't come out.
    """
    salted = _dealt(df, keys, member, salts, partitions)
    grouped = salted.groupBy(*keys, "_salt", member).agg(*[e.alias(c) for c, e in aggs.items()])
    local = grouped.groupBy(*keys, "_salt").agg(*[F.sum(e).alias(c) for c, e in sums.items()])
    whole = Window.partitionBy(*keys)
    totals = local.select(*keys, "_salt", *[F.sum(c).over(whole).alias(c) for c in sums])
    return grouped.join(totals.hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")
