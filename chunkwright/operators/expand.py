"""Neighbour expansion: the chunks before and after each hit, in its own section."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE = ("source_document", "section_path", "chunk_index")


def neighbour_places(hits: DataFrame, n: int, by: str = "query_id") -> DataFrame:
    """(by, place of a neighbour, rank of the first hit it stands beside): up to ``n`` on either side, inside the section, not already a hit, each once."""
    beside = hits.select(by, *PLACE, "chunk_total", "rank", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("_step")).where("_step != 0")
    moved = beside.withColumn("chunk_index", (F.col("chunk_index") + F.col("_step")).cast("int")).where("chunk_index >= 0 AND chunk_index < chunk_total")
    once = moved.groupBy(by, *PLACE).agg(F.min("rank").alias("rank"))
    taken = hits.select(F.col(by).alias("_by"), *[F.col(c).alias(f"_{c}") for c in PLACE])
    same = F.col(by).eqNullSafe(F.col("_by"))
    for c in PLACE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return once.join(taken, same, "left_anti")


def expand(hits: DataFrame, chunks: DataFrame, n: int = 1, by: str = "query_id", key: str = "id") -> DataFrame:
    """(by, key, rank, is_hit, ord): the hits, then their neighbours in the order of the hits they stand beside.

    ``hits`` has by, rank, key, the place and chunk_total. Neighbours are found by one
    equi-join on document, path and index; several chunks at one place all come out. With
    ``n`` of 0 or less, the hits alone do.
    """
    base = hits.select(by, key, "rank", F.lit(True).alias("is_hit"))
    if n > 0:
        places = neighbour_places(hits, n, by)
        found = chunks.select(key, *PLACE).join(places, list(PLACE)).select(by, key, "rank", F.lit(False).alias("is_hit"))
        base = base.unionByName(found)
    order = Window.partitionBy(by).orderBy(F.desc("is_hit"), "rank", key)
    return base.withColumn("ord", F.row_number().over(order))


def chunks_at(chunks: DataFrame, document: str, indices: list[int], path: str | None = None) -> DataFrame:
    """The chunks of a document with the given indices, of one section if ``path`` is filled; none for no indices."""
    if not indices:
        return chunks.limit(0)
    found = chunks.where((F.col("source_document") == document) & F.col("chunk_index").isin(indices))
    return found.where(F.col("section_path") == path) if path else found
