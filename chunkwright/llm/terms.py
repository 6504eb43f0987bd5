"""Problem 2: how distinctive a term is for a record, by log-entropy weighting.

Two SQL aggregations: the frequency of each term in each record, and for each term the
entropy of its spread over the records. The weight is log(1 + frequency) times one minus
the entropy, normalised by the logarithm of the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.text import BETWEEN_TERMS
from chunkwright.operators.skew import grouped_with_totals, partitions_for

#: Bytes that the pairs of term and record take in a shuffle for each byte of the stored table.
TERM_BYTES = 4


def term_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, term), one row for each occurrence."""
    return df.select(key, F.explode(F.split(F.lower(F.col(text)), BETWEEN_TERMS)).alias("term")).where("term != ''")


def records_with_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """One number: the different keys among the rows whose text has a term."""
    return df.where(F.col(text).rlike(r"[\p{L}\p{N}]")).agg(F.countDistinct(F.coalesce(F.col(key).cast("string"), F.lit("")) if key == text else F.col(key)).alias("n"))


def log_entropy(df: DataFrame, key: str = "chunk_no", text: str = "text") -> DataFrame:
    """(``key``, term, tf, df, gf, score): every term of every record.

    ``tf`` counts the term in the record, ``gf`` in all records, ``df`` the records. With
    p = tf / gf, entropy is -sum p ln p and the score ln(1 + tf) * (1 - entropy / ln n) for n
    records that have a term; with a single such record it is ln(1 + tf). Rows that share a
    key are one record; null and empty texts have no terms and give no rows, as do null
    keys. Other columns are ignored.
    """
    known = df.where(F.col(key).isNotNull())
    partitions = partitions_for(known.select(key, text), TERM_BYTES)
    counted = grouped_with_totals(
        term_rows(known, key, text), ["term"], key, {"tf": F.count(F.lit(1))},
        {"df": F.lit(1), "gf": F.col("tf"), "_tlogt": F.when(F.col("tf") > 1, F.col("tf") * F.log(F.col("tf").cast("double"))).otherwise(0.0)},
        partitions=partitions,
    )
    n = F.log(records_with_terms(known, key, text).scalar().cast("double"))
    entropy = F.log(F.col("gf").cast("double")) - F.col("_tlogt") / F.col("gf")
    weight = F.when(F.col("df") > 1, 1 - entropy / n).otherwise(1.0)
    return counted.select(key, "term", "tf", "df", "gf", (F.log1p(F.col("tf").cast("double")) * weight).alias("score"))
