"""Problem 4: near-duplicate records with small edits.

Each text's set of shingles (consecutive terms) is sampled by MinHash. Bands of the samples
give the candidates; the samples folded into a parity bitmap (an odd sketch, Mitzenmacher,
Pagh and Pham, 2014) verify them: the population count of two bitmaps' XOR estimates the
similarity precisely where it is high. What the sketch can't rule out is checked exactly on
the shingle sets. Texts of equal shingle sets are one class, and only its representative
takes part in the search.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.llm.pairs import class_pairs
from chunkwright.operators.components import connected_components
from chunkwright.operators.skew import with_key_totals
from chunkwright.session import checkpointed

#: Terms in a shingle, and the Jaccard similarity from which texts are near-duplicates.
WORDS = 3
THRESHOLD = 0.6
#: A pair at the threshold shares no band with a probability of (1 - 0.6 ** 4) ** 60 = 0.02 %.
BANDS = 60
ROWS = 4
#: Bits of an odd sketch.
BITS = 512
#: Standard deviations that the sketch's estimate may fall short of the threshold.
SLACK = 4.5
#: Buckets with more members are compared in blocks of about this many, spread over tasks.
BLOCK = 512
#: Classes of more copies meet the classes they are linked to in blocks of about this many.
COPIES_BLOCK = 1000

TERM = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Hashes of terms, computed once; emptied when it has grown."""

    def __missing__(self, term: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        self[term] = value = xxh64_intdigest(term)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: list[str | None], words: int, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all shingles, where each kept text's begin, which texts were kept): texts of fewer terms than a shingle aren't."""
    found, kept, counts = [], [], []
    for i, text in enumerate(texts):
        if text is None:
            continue
        terms = TERM.findall(text.lower())
        if len(terms) >= words:
            found += terms
            kept.append(i)
            counts.append(len(terms))
    flat = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = np.array(counts, np.int64)
    grams = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for j in range(words):
        grams = _mixed(grams * np.uint64(3) + flat[j : len(flat) - words + 1 + j])
    last = np.ones(len(flat), bool)  # no shingle runs over the end of its text
    ends = np.cumsum(n)
    for j in range(1, words):
        last[ends - j] = False
    starts = np.concatenate(([0], np.cumsum(n - words + 1)))
    return grams[last[: len(grams)]], starts, np.array(kept, np.int64)


def signatures(grams: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """MinHash samples, a row for each text: the least of its shingles' hashes after a flip of random bits and a multiplication by a random odd number, another one for each sample."""
    rng = np.random.default_rng(4)
    factors = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, 2**64, samples, dtype=np.uint64)
    out = np.empty((len(starts) - 1, samples), np.uint64)
    at = 0
    while at < len(out):  # a few texts at a time, to stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 16_384, "right")) - 1)
        part, begin = grams[starts[at] : starts[to]], starts[at:to] - starts[at]
        for k in range(samples):
            out[at:to, k] = np.minimum.reduceat((part ^ flips[k]) * factors[k], begin)
        at = to
    return out


def odd_sketches(mins: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps as rows of 64-bit words: each sample flips the bit that its number and value hash to."""
    n, samples = mins.shape
    at = _mixed(mins + np.arange(samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    flips = np.bincount((at + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(bits)).astype(np.int64).ravel(), minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def most_differing_bits(threshold: float, samples: int, bits: int, slack: float = SLACK) -> int:
    """The XOR population count up to which a pair at the threshold may lie, ``slack`` standard deviations out."""
    def bits_at(j: float) -> float:
        return bits / 2 * (1 - math.exp(-4 * samples * (1 - j) / bits))

    p = bits_at(threshold) / bits
    low = max(0.0, threshold - slack * math.hypot(math.sqrt(threshold * (1 - threshold) / samples), math.sqrt(bits * p * (1 - p)) / (2 * samples * (1 - 2 * p))))
    return math.ceil(bits_at(low))


def sketch_arrow(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    """(key, c1, c2, size, bands, s0, s1, ...) of (key, text): c1 and c2 are 128 bits that stand for the set of shingles."""
    from xxhash import xxh3_128_digest

    hashes = _Hashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            grams, starts, kept = shingles(batch.column(1).to_pylist(), words, hashes)
            if not len(kept):
                continue
            sets = [np.unique(grams[a:z]) for a, z in zip(starts[:-1], starts[1:], strict=True)]
            classes = np.frombuffer(b"".join(xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            mins = signatures(grams, starts, bands * rows)
            keyed = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows):
                keyed = _mixed(keyed + mins[:, r::rows])
            sketch = odd_sketches(mins, bits)
            ends = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * bands)
            columns = [batch.column(0).take(pa.array(kept)), pa.array(classes[:, 0]), pa.array(classes[:, 1]), pa.array(np.array([len(s) for s in sets], np.int32)), pa.ListArray.from_arrays(ends, pa.array(keyed.astype(np.int64).ravel()))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(bits // 64)]], names=["key", "c1", "c2", "size", "bands", *[f"s{i}" for i in range(bits // 64)]])


def shared_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (band, key) sorted by band, the rows that share theirs with a neighbour, and a partition's first and last, which may with a row elsewhere."""
    band = key = None
    linked = True  # the first row of the partition
    for batch in batches:
        if not batch.num_rows:
            continue
        bands = batch.column(0).to_numpy()
        keys = batch.column(1)
        same = bands[1:] == bands[:-1]
        if band is not None:
            joins = bool(band == bands[0])
            if linked or joins:
                yield pa.RecordBatch.from_arrays([pa.array([band]), pa.concat_arrays([key])], names=["band", "key"])
            linked = joins
        keep = np.concatenate(([linked], same)) | np.concatenate((same, [False]))
        keep[-1] = False  # held back until the next row is known
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(bands[keep]), keys.filter(pa.array(keep))], names=["band", "key"])
        linked = bool(same[-1]) if len(same) else linked
        band, key = bands[-1], keys.slice(len(bands) - 1)
    if band is not None:
        yield pa.RecordBatch.from_arrays([pa.array([band]), pa.concat_arrays([key])], names=["band", "key"])


def set_arrow(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(key, grams): the set of shingles of each text."""
    hashes = _Hashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            grams, starts, kept = shingles(batch.column(1).to_pylist(), words, hashes)
            sets = [np.unique(grams[a:z]).view(np.int64) for a, z in zip(starts[:-1], starts[1:], strict=True)] if len(kept) else []
            ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
            values = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(ends, values)], names=["key", "grams"])


class NearDuplicates:
    """The links between classes of texts, and who is in each class.

    ``links``: (a, b, similarity) between representatives of different classes, each once, a < b.
    ``copies``: (key, class_key, n): the rows of every class of several rows, with its representative.
    ``keys``: (key): every row that took part.
    """

    def __init__(self, df: DataFrame, key: str = "chunk_no", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, bits: int = BITS):
        """Texts that are null or have fewer terms than a shingle take no part. Keys should be unique; rows that share one are taken as the same row where their texts agree."""
        texts = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
        kind = texts.schema["key"].dataType
        words_in = [f"s{i}" for i in range(bits // 64)]
        fields = [T.StructField("key", kind), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(s, T.LongType()) for s in words_in]]
        sketched = checkpointed(texts.mapInArrow(lambda b: sketch_arrow(b, words, bands, rows, bits), T.StructType(fields)))
        self.keys = sketched.select("key")
        classed = with_key_totals(sketched.select("key", "c1", "c2").distinct(), ["c1", "c2"], "key", {"class_key": F.col("key")}, combine=F.min)
        others = classed.where("key != class_key").select("key", "class_key")
        sized = with_key_totals(others, ["class_key"], "key", {"n": F.lit(1)})
        others = checkpointed(sized.select("key", "class_key", (F.col("n") + 1).alias("n")))
        heads = others.groupBy("class_key").agg(F.first("n").alias("n")).select(F.col("class_key").alias("key"), "class_key", "n")
        self.copies = others.unionByName(heads)
        first = sketched.join(others.select("key"), "key", "left_anti")
        banded = first.select(F.explode("bands").alias("band"), "key")
        shared = checkpointed(banded.repartitionByRange("band", "key").sortWithinPartitions("band", "key").mapInArrow(shared_arrow, T.StructType([T.StructField("band", T.LongType()), T.StructField("key", kind)])))
        buckets = checkpointed(with_key_totals(shared.distinct(), ["band"], "key", {"n": F.lit(1)}).where("n > 1"))
        small = buckets.where(f"n <= {2 * BLOCK}")
        candidates = small.select("band", F.col("key").alias("a")).join(small.select("band", F.col("key").alias("b")), "band").where("a < b").select("a", "b")
        far = most_differing_bits(threshold, bands * rows, bits)
        sketch = first.select("key", "size", *words_in)
        candidates = candidates.unionByName(self._blocks(buckets.where(f"n > {2 * BLOCK}"), sketch, words_in, far, kind)).distinct()
        left = sketch.select(F.col("key").alias("a"), F.col("size").alias("_na"), *[F.col(s).alias(f"_a{s}") for s in words_in])
        right = sketch.select(F.col("key").alias("b"), F.col("size").alias("_nb"), *[F.col(s).alias(f"_b{s}") for s in words_in])
        differ = sum((F.bit_count(F.col(f"_a{s}").bitwiseXOR(F.col(f"_b{s}"))) for s in words_in), F.lit(0))
        sizes_allow = F.least("_na", "_nb") >= F.greatest("_na", "_nb") * F.lit(threshold)
        likely = checkpointed(candidates.join(left, "a").join(right, "b").where(sizes_allow & (differ <= far)).select("a", "b"))
        wanted = likely.select(F.col("a").alias("key")).unionByName(likely.select(F.col("b").alias("key"))).distinct()
        sets = texts.join(wanted, "key", "left_semi").mapInArrow(lambda b: set_arrow(b, words), T.StructType([T.StructField("key", kind), T.StructField("grams", T.ArrayType(T.LongType()))]))
        both = likely.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("_ga")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("_gb")), "b")
        common = F.size(F.array_intersect("_ga", "_gb"))
        checked = both.select("a", "b", common.alias("_common"), (F.size("_ga") + F.size("_gb") - common).alias("_all"))
        self.links = checkpointed(checked.where(F.col("_common") * 1_000_000 >= F.col("_all") * round(threshold * 1_000_000)).select("a", "b", (F.col("_common") / F.col("_all")).alias("similarity")))

    @staticmethod
    def _blocks(buckets: DataFrame, sketch: DataFrame, words_in: list[str], far: int, kind: T.DataType) -> DataFrame:
        """Pairs of the large buckets that their sketches allow.

        A bucket's members are dealt to blocks, and every two blocks are compared in a task
        of their own: each member goes to as many tasks as its bucket has blocks, no task
        gets more than two blocks, and only pairs that pass the sketch come out.
        """
        n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        members = buckets.select("band", "key", n_blocks.alias("_g")).withColumn("_of", F.pmod(F.xxhash64("key"), F.col("_g")).cast("int"))
        members = members.join(sketch, "key").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
        dealt = members.withColumn("_i", F.least("_of", "_other")).withColumn("_j", F.greatest("_of", "_other"))

        def compare(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            bits = pdf[words_in].to_numpy(np.int64).view(np.uint64)
            key, of, i = pdf["key"].to_numpy(), pdf["_of"].to_numpy(), pdf["_i"].iloc[0]
            alone = i == pdf["_j"].iloc[0]
            a, b = np.flatnonzero(of == i), np.flatnonzero(of == pdf["_j"].iloc[0])
            out = []
            for at in range(0, len(a), 64):
                some = a[at : at + 64]
                differ = np.bitwise_count(bits[some, None, :] ^ bits[None, b, :]).sum(2, dtype=np.int64)
                x, y = np.nonzero(differ <= far)
                x, y = some[x], b[y]
                if alone:
                    x, y = x[y > x], y[y > x]
                out.append(pd.DataFrame({"a": np.minimum(key[x], key[y]), "b": np.maximum(key[x], key[y])}))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": key[:0], "b": key[:0]})

        return dealt.groupBy("band", "_i", "_j").applyInPandas(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).where("a != b")

    def pairs(self, max_copies: int | None = None) -> DataFrame:
        """(a, b): pairs of rows, copies included.

        Every row of a class takes part, so pairs are quadratic in its rows; large classes
        are joined in blocks. With ``max_copies``, a class of more rows takes part with its
        representative only, to which its other rows are linked, whether they are exact
        copies or differ in case, punctuation or repetition.
        """
        copies = self.copies if max_copies is None else self.copies.where(F.col("n") <= max_copies)
        blocks = F.ceil(F.col("n") / COPIES_BLOCK).cast("int")
        dealt = copies.select("key", "class_key", F.pmod(F.xxhash64("key"), blocks).cast("int").alias("_of"))
        counts = copies.select("class_key", blocks.alias("_g")).distinct()
        as_a, as_b = (dealt.select(F.col("class_key").alias(x), F.col("_of").alias(f"_{x}_of"), F.col("key").alias(f"_k{x}")) for x in ("a", "b"))
        spread = self.links.select("a", "b")
        for x in ("a", "b"):
            spread = spread.join(counts.select(F.col("class_key").alias(x), F.col("_g").alias(f"_{x}_g")), x, "left").withColumn(f"_{x}_of", F.explode(F.sequence(F.lit(0), F.coalesce(f"_{x}_g", F.lit(1)) - 1)))
        spread = spread.join(as_a, ["a", "_a_of"], "left").join(as_b, ["b", "_b_of"], "left").where("(_a_g IS NULL OR _ka IS NOT NULL) AND (_b_g IS NULL OR _kb IS NOT NULL)")
        spread = spread.select(F.coalesce("_ka", "a").alias("x"), F.coalesce("_kb", "b").alias("y"))
        within = class_pairs(self.copies, "key", "class_key", max_full=max_copies)
        return spread.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(within.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))

    def groups(self) -> DataFrame:
        """(key, group_key, links): every row that took part, the smallest key it is linked to over any number of links, and the links of its class."""
        parts = connected_components(self.links, "a", "b")
        degree = self.links.select(F.col("a").alias("_n")).unionByName(self.links.select(F.col("b").alias("_n"))).groupBy("_n").agg(F.count("*").alias("links"))
        classed = self.keys.join(self.copies.select("key", "class_key"), "key", "left").withColumn("class_key", F.coalesce("class_key", "key"))
        joined = classed.join(parts.select(F.col("node").alias("class_key"), "component"), "class_key", "left").join(degree.withColumnRenamed("_n", "class_key"), "class_key", "left")
        return joined.select("key", F.coalesce("component", "class_key").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))
