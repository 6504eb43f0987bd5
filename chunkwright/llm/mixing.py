"""Problem 8: mixing sources to target weights.

Each source's texts, laid end to end in a pseudorandom order, are a stream of tokens that is
cut into blocks of fixed length. Each output shard draws how many of its slots go to each
source from a multinomial distribution, conditioned on the sources' quotas coming out
exactly. The n-th slot of a source is mapped through a pseudorandom permutation of the
source's blocks, another one for each repetition, and slots and blocks are joined by index.
Which blocks a shard gets is computed from its number alone: nothing is drawn on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwright.functions.text import size_tokens
from chunkwright.operators.positions import with_offsets
from chunkwright.session import checkpointed

BLOCK = 1024
SHARD_SLOTS = 4096
#: The targets are a configuration table that goes to the driver; more rows than this are refused.
MAX_TARGETS = 100_000


def permuted(index: np.ndarray, n: int, seed: int | list[int]) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 takes each index: a Feistel network over the next even power of two, walked until it falls below n."""
    bits = max(2, (n - 1).bit_length() + 1 & ~1)
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << bits // 2) - 1)
    keys = np.random.SeedSequence(seed).generate_state(6, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _marked(marked: int, others: int, drawn: int, rng: np.random.Generator) -> int:
    """How many of ``drawn`` slots out of ``marked`` and ``others`` are marked: a hypergeometric draw.

    The generator's own stops at 10 ** 9. Beyond, the draw is binomial where few are marked
    or drawn (or few are not), else normal, with the same mean and variance; both are within
    a thousandth of the exact law there.
    """
    total = marked + others
    if total < 1_000_000_000:
        return int(rng.hypergeometric(marked, others, drawn))
    mean = drawn * (marked / total)
    spread = mean * (others / total) * ((total - drawn) / (total - 1))
    least, most = max(0, drawn - others), min(marked, drawn)
    if spread > 1_000_000:
        n = round(mean + float(rng.standard_normal()) * spread**0.5)
    else:
        if 2 * drawn > total:
            return marked - _marked(marked, others, total - drawn, rng)
        if 2 * marked > total:
            return drawn - _marked(others, marked, drawn, rng)
        few, many = sorted((marked, drawn))
        n = int(rng.binomial(few, many / total))
    return min(most, max(least, n))


def _draw(quota: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How a node's first ``slots`` slots fall on the sources: each source's share is drawn given those before it."""
    others = int(quota.sum())
    if slots >= others:
        return quota.copy()
    out = np.zeros_like(quota)
    for i, marked in enumerate(quota.tolist()):
        others -= marked
        out[i] = _marked(marked, others, slots, rng) if slots else 0
        slots -= int(out[i])
    return out


def shard_draw(shard: int, shards: int, slots: int, quota: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it), by halving the shards down to this one."""
    low, high, left_over, before = 0, shards, quota.astype(np.int64), np.zeros(len(quota), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = _draw(left_over, (middle - low) * slots, np.random.default_rng([seed, low, high]))
        if shard < middle:
            left_over, high = first, middle
        else:
            before, left_over, low = before + first, left_over - first, middle
    return before, left_over


@dataclass(frozen=True)
class Plan:
    """Per source: target, sizes, blocks and quota of slots; and the total size of all rows."""

    sources: tuple[str, ...]
    permille: tuple[int, ...]
    repeats: tuple[int, ...]
    sizes: tuple[int, ...]
    blocks: tuple[int, ...]
    quota: tuple[int, ...]
    total: int


def sized(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, key, _size) of every row, checkpointed: texts are read once, and what follows works on their sizes."""
    return checkpointed(df.select(F.col(source).alias("source"), F.col(key), size_tokens(F.col(text)).alias("_size")))


def slots_needed(target: int, size: int, repeats: int, block: int) -> int:
    """The slots that surely hold ``target`` tokens of a source, whichever of its blocks they get, or all it may give: the last block of a source may be short."""
    n = -(-size // block)
    if size * repeats <= target:
        return n * repeats
    times, rest = divmod(target, size)
    return times * n + min(n, -(-(rest + n * block - size) // block) if rest else 0)


def plan_mix(sizes: DataFrame, targets: DataFrame, block: int = BLOCK) -> Plan:
    """Adds up the sources of ``sized`` and sets each one's quota: the slots that hold its share of the total size, or all its blocks as often as allowed if that isn't enough."""
    listed = targets.groupBy("source").agg(F.sum("target_permille").alias("p"), F.max("max_repeats").alias("r")).where("source IS NOT NULL")
    by_source = sizes.groupBy("source").agg(F.sum("_size").alias("size"))
    total = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    rows = listed.join(by_source, "source", "left").select("source", "p", "r", F.coalesce("size", F.lit(0)).alias("size")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources have targets")
    blocks = [-(-r["size"] // block) for r in rows]
    p, times = [max(0, r["p"] or 0) for r in rows], [max(0, r["r"] or 0) for r in rows]
    quota = [slots_needed(-(-x * total // 1000), r["size"], t, block) for r, x, t in zip(rows, p, times, strict=True)]
    return Plan(tuple(r["source"] for r in rows), tuple(p), tuple(times), tuple(r["size"] for r in rows), tuple(blocks), tuple(quota), total)


def blocks(sizes: DataFrame, plan: Plan, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(source, block, part, key, byte_start, byte_length): what each block of each listed source is made of, in order."""
    rows = sizes.where(F.col("_size") > 0).where(F.col("source").isin([s for s, q in zip(plan.sources, plan.quota, strict=True) if q]))
    placed = with_offsets(rows.withColumn("_h", F.xxhash64(key)), ["source"], ["_h", key, "_size"], F.col("_size"), "_from", "_all")
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_from + _size - 1) div {block}"))))
    start = F.greatest(F.col("_from"), F.col("block") * block)
    end = F.least(F.col("_from") + F.col("_size"), (F.col("block") + 1) * block)
    return cut.select("source", "block", (start - F.col("block") * block).alias("part"), key, (start - F.col("_from")).alias("byte_start"), (end - start).alias("byte_length"))


def slots(df: DataFrame, plan: Plan, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """(shard, slot, source, repeat, block): what each slot of the output holds; ``df`` gives the session only."""
    quota = np.array(plan.quota, np.int64)
    shards = max(1, -(-int(quota.sum()) // shard_slots)) if len(quota) else 0

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for shard in pdf["id"]:
                before, drawn = shard_draw(int(shard), shards, shard_slots, quota, seed)
                out = []
                for i, n in enumerate(drawn):
                    nth = np.arange(before[i], before[i] + n)
                    repeat, index = np.divmod(nth, plan.blocks[i] or 1)
                    where = np.empty(n, np.int64)
                    for r in np.unique(repeat):
                        of = repeat == r
                        where[of] = permuted(index[of], plan.blocks[i], [seed, i, int(r)])
                    out.append(pd.DataFrame({"source": plan.sources[i], "repeat": repeat, "block": where}))
                mixed = pd.concat(out, ignore_index=True)
                order = np.random.default_rng([seed, int(shard)]).permutation(len(mixed))
                yield mixed.assign(shard=shard, slot=order)[["shard", "slot", "source", "repeat", "block"]]

    return df.sparkSession.range(shards).mapInPandas(fill, "shard bigint, slot bigint, source string, repeat bigint, block bigint")


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> tuple[DataFrame, Plan]:
    """The mixture as (shard, slot, source, repeat, block, part, key, byte_start, byte_length) and its plan.

    Rows refer to bytes of the stored texts; ``part`` orders them inside their block. Every
    source gets its share of the total size of all rows, and two blocks more at most; one that can't even with
    all repeats gives all it has that often, and what is missing is not made up from others.
    Null and empty texts and rows of unlisted or null sources have no part in it but count
    to the total. Rows that repeat a key are rows of their own. Empty tables give no rows.
    """
    sizes = sized(df, key, text, source)
    plan = plan_mix(sizes, targets, block)
    made = blocks(sizes, plan, key, block)
    # the optimizer takes the slots for as few as the shards they are made from and would broadcast them
    return slots(df, plan, shard_slots, seed).join(made.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "part", key, "byte_start", "byte_length"), plan


def mix_report(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """For each source of the targets: size, target, the size and share of the total that the mixture really holds, and whether that falls short of the target."""
    mixed, plan = mix(df, targets, key, text, source, block, shard_slots, seed)
    reached = mixed.groupBy("source").agg(F.sum("byte_length").alias("_reached"))
    base = df.sparkSession.createDataFrame(list(zip(plan.sources, plan.permille, plan.repeats, plan.sizes, strict=True)), "source string, target_permille int, max_repeats int, source_size bigint")
    out = base.join(reached, "source", "left").withColumn("reached_size", F.coalesce("_reached", F.lit(0)))
    whole = F.lit(float(plan.total or 1))
    short = F.col("reached_size") * 1000 < F.col("target_permille").cast("bigint") * F.lit(plan.total)
    return out.select("source", "target_permille", "max_repeats", "source_size", "reached_size", F.round(F.col("reached_size") * 1000 / whole, 4).alias("reached_permille"), short.alias("short"))


def mixed_tokens(mixed: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, slot, source, tokens): the tokens of each slot, that is its bytes. One join on the key, which must be unique in ``df``; a slot has at most a block's bytes, so its parts gather in one row."""
    texts = df.select(F.col(key).alias("_key"), F.encode(text, "UTF-8").alias("_bytes"))
    cut = F.expr("substring(_bytes, cast(byte_start + 1 AS int), cast(byte_length AS int))")
    parts = mixed.join(texts, F.col(key) == F.col("_key")).select("shard", "slot", "source", F.struct("part", cut.alias("bytes")).alias("_p"))
    gathered = parts.groupBy("shard", "slot", "source").agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    return gathered.select("shard", "slot", "source", F.aggregate("_ps", F.lit(b""), lambda s, p: F.concat(s, p["bytes"])).alias("tokens"))
