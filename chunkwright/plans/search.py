"""Whole searches as one plan: retrieve, fuse, expand, rerank, cite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.text import context_entry, embedding_text
from chunkwright.operators.bm25 import TextPostings, bm25_top_k
from chunkwright.operators.dense import dense_top_k
from chunkwright.operators.expand import expand
from chunkwright.operators.fusion import branch_budgets, fuse
from chunkwright.operators.rerank import Judge, judge, judge_answers, judge_prompt, overlap_score, rerank
from chunkwright.schema import Config
from chunkwright.session import checkpointed

NOTHING = "No relevant information found."


def hybrid_top_k(chunks: DataFrame, queries: DataFrame, key: str, k: int, config: Config = Config(), dimensions: int = 64, postings: TextPostings | None = None) -> DataFrame:
    """(query_id, key, score, rank): a dense and a sparse branch with budgets by weight, fused by reciprocal ranks. The sparse one reads ``postings`` if they are given, else the texts.

    ``queries`` has query_id, text and vec; one without a vector or without known terms is
    served by its other branch.
    """
    n_dense, n_sparse = branch_budgets(k, config.dense_weight)
    dense = dense_top_k(chunks, queries, key, n_dense, dimensions=dimensions)
    sparse = bm25_top_k(chunks if postings is None else postings, queries, key, n_sparse, config.scoring, float(config.max_chunk_tokens), config.k1, config.b)
    return fuse(dense, sparse, by="query_id", key=key, k=k)


def search(chunks: DataFrame, queries: DataFrame, key: str = "id", config: Config = Config(), k: int | None = None, score: Callable[[Column, Column], Column] = overlap_score, dimensions: int = 64, postings: TextPostings | None = None, judged_by: Callable[[], Judge] | None = None) -> DataFrame:
    """The ``k`` best chunks of each query: (query_id, new_rank, relevance_score, original_rank and the chunk's columns without its vector).

    Twice ``k`` are retrieved, their neighbours added, and all of them reranked by
    ``score(query, text under its header)``, or by the answers of ``judged_by``'s judge with
    the configured threshold.
    """
    k = config.top_k if k is None else k
    stored = chunks.drop("embedding")
    hits = hybrid_top_k(chunks, queries, key, k * config.retrieval_factor, config, dimensions, postings)
    placed = hits.join(stored.select(key, "source_document", "section_path", "chunk_index", "chunk_total"), key)
    widened = expand(placed, stored, config.adjacent_chunks, key=key).select("query_id", key, F.col("ord").alias("original_rank"))
    found = widened.join(stored, key).join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    text = embedding_text(F.col("source_document"), F.col("section_path"), F.col("section"), F.col("text"))
    if judged_by is not None:
        found = checkpointed(found)  # the plan of the answers must see the ranks that they are joined by
        prompts = judge_prompt(found.withColumn("_text", text), text="_text", query="_query")
        return judge(found.drop("_query"), k, checkpointed(judge_answers(prompts, judged_by)), config.minimum_relevance)
    return rerank(found, k, score(F.col("_query"), text)).drop("_query")


def contexts(results: DataFrame, queries: DataFrame, rank: str = "new_rank") -> DataFrame:
    """(query_id, context): each query's results as cited text in their order; a query without any says so."""
    entry = context_entry(*[F.col(c) for c in ("source_document", "section_path", "section", "start_page", "end_page", "text")])
    told = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), entry.alias("entry")))), lambda x: x["entry"]), "").alias("_told"))
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit("Context from documents:\n\n"), "_told"), F.lit(NOTHING)).alias("context"))
