"""Vectors and scores as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smoothing constant of reciprocal rank fusion (Cormack, Clarke and Büttcher, 2009).
RRF_K = 60
K1 = 1.2
B = 0.75


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, an error where lengths differ, null for null."""
    both = norm(a) * norm(b)
    value = F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(value)


def unit(a: Column) -> Column:
    """The vector at norm 1; a zero vector stays."""
    return F.when(norm(a) == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / norm(a)))


def is_usable(a: Column, dimensions: int) -> Column:
    """Whether the vector has ``dimensions`` finite numbers that aren't all zero."""
    finite = F.forall(_double(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(a) == dimensions) & finite & F.exists(_double(a), lambda x: x != 0), F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def yes_probability(yes: Column, no: Column) -> Column:
    """Softmax of two logits, the share of ``yes``."""
    return sigmoid(yes - no)


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency as BM25 has it, never negative; n is 1 at least."""
    n = F.greatest(n, F.lit(1)).cast("double")
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def tf_saturation(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (F.lit(float(k)) + rank)
