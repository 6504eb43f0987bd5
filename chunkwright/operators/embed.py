"""Embeddings by a pluggable model, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.text import embedding_text

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hashing_embedder(dimensions: int = 384) -> Embedder:
    """Deterministic vectors of norm 1 without a model: signed hashes of a text's terms; zero for a text without terms."""
    import re

    from xxhash import xxh64_intdigest

    term = re.compile(r"[^\W_]+")

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float64)
        for row, text in enumerate(texts):
            for t in term.findall((text or "").lower()):
                h = xxh64_intdigest(t)
                out[row, h % dimensions] += 1 if h >> 63 else -1
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

    return embed


def mean_pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Token states (texts x tokens x dimensions) averaged where the mask is set, at norm 1."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (states * weight).sum(1) / np.clip(weight.sum(1), 1e-9, None)
    return mean / np.clip(np.sqrt((mean * mean).sum(1, keepdims=True)), 1e-12, None)


def pooled_embedder(encode: Callable[[str], Sequence[int]], states: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = 512) -> Embedder:
    """An embedder of a model that gives token states: texts are encoded and cut to ``limit`` tokens, padded with zeros to the longest, and the states (texts x tokens x dimensions) of ``states(ids, mask)`` are averaged over each text's own tokens, at norm 1. A text without tokens gets zeros."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        tokens = [list(encode(t or ""))[:limit] for t in texts]
        width = max(1, *map(len, tokens)) if tokens else 1
        ids, mask = np.zeros((len(tokens), width), np.int64), np.zeros((len(tokens), width), np.int64)
        for row, own in enumerate(tokens):
            ids[row, : len(own)], mask[row, : len(own)] = own, 1
        return mean_pooled(np.asarray(states(ids, mask)), mask).astype(np.float32)

    return embed


def embedded(text: Column, load: Callable[[], Embedder], batch: int = 50) -> Column:
    """The text's vector. ``load`` is called once in each Python worker and the model with up to ``batch`` texts at a time, in order; null texts are embedded as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            texts = texts.fillna("").tolist()
            vectors = [v for at in range(0, len(texts), batch) for v in model(texts[at : at + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors], dtype=object)

    return run(text)


def embed_chunks(chunks: DataFrame, load: Callable[[], Embedder], batch: int = 50) -> DataFrame:
    """Chunks with ``embedding`` of their text under its header."""
    text = embedding_text(F.col("source_document"), F.col("section_path"), F.col("section"), F.col("text"))
    return chunks.withColumn("embedding", embedded(text, load, batch))


def embed_queries(queries: DataFrame, load: Callable[[], Embedder], text: str = "text", out: str = "vec") -> DataFrame:
    """Queries with the vector of their bare text."""
    return queries.withColumn(out, embedded(F.col(text), load))
