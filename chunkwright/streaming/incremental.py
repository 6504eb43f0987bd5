"""Incremental indexing: a stream of chunks upserted into a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chunkwright.sources.store import ChunkStore


def upsert_stream(chunks: DataFrame, store: ChunkStore, checkpoint: str, order: str | None = None, **trigger: object) -> StreamingQuery:
    """Starts a query that upserts each micro-batch. A batch that is replayed after a failure replaces its own rows, so the index is right once it is through."""
    store.create()

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(batch, order)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
