"""Dense retrieval: exact cosine top-k of a set of queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chunkwright.functions.vector import is_usable
from chunkwright.operators.bm25 import top_k
from chunkwright.operators.topk import RunningTop
from chunkwright.session import checkpointed

#: Queries that go to the driver and the executors at a time; of a larger set, each block is a pass over the rows, checkpointed before the next begins.
QUERY_BLOCK = 8192


def _rows(vectors: pa.Array, dimensions: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def dense_scores(chunks: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding", query_key: str = "query_id", query_vector: str = "vec", dimensions: int = 64) -> DataFrame:
    """(``query_key``, ``key``, score): for each query, the rows that are among its ``k`` best of a partition.

    A superset of the overall top k, small enough to rank: the rows stay where they are and
    are multiplied by a block of queries at a time. Unusable vectors on either side take no
    part. Of ties, the smaller keys come first.
    """
    asked = queries.where(is_usable(F.col(query_vector), dimensions)).select(query_key, query_vector).orderBy(query_key)
    rows = chunks.where(is_usable(F.col(vector), dimensions)).select(key, vector)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType())])
    kind, key_kind = to_arrow_type(schema[query_key].dataType), to_arrow_type(schema[key].dataType)
    def found(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        q = np.array([list(r[1]) for r in block], np.float64)
        q /= np.sqrt((q * q).sum(1, keepdims=True))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = RunningTop(len(ids), k)
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    top.add(np.round(q @ _rows(batch.column(1), dimensions).T, 6), batch.column(0).to_numpy(zero_copy_only=False))
            i, keys, s = top.best()
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], kind), pa.array(keys, key_kind), pa.array(s)], names=[query_key, key, "score"])

        return rows.mapInArrow(scored, schema)

    out = queries.sparkSession.createDataFrame([], schema)
    block = []
    first = asked.limit(QUERY_BLOCK + 1).collect()
    if len(first) <= QUERY_BLOCK:
        return out.unionByName(found(first)) if first else out
    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(checkpointed(found(block))), []
    return out.unionByName(checkpointed(found(block))) if block else out


def dense_top_k(chunks: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding", query_key: str = "query_id", query_vector: str = "vec", dimensions: int = 64) -> DataFrame:
    """(``query_key``, ``key``, score, rank): the ``k`` rows of the largest cosine for each query; an empty table gives none."""
    if k < 1:
        raise ValueError("k must be positive")
    return top_k(dense_scores(chunks, queries, key, k, vector, query_key, query_vector, dimensions), k, query_key, key)
