"""Problem 7: filling fixed-capacity containers with items.

Items are dealt to shards of bounded size by a hash, and each shard is packed on its own
by bin completion: a branch-and-bound search that fills one container at a time around the
largest item left, over all fillings that no other filling dominates, and gives up a branch
as soon as its waste rules out a better packing than the incumbent. The best-fit packing is
the first incumbent. Only keys and sizes move; texts are cut by the offsets that come out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.functions.text import size_tokens
from chunkwright.session import checkpointed

CAPACITY = 8192
#: A shard's size in tokens and rows; more of them waste more in last containers, larger ones take longer each.
SHARD_TOKENS = 4 << 20
SHARD_ROWS = 50_000
MAX_TASKS = 10_000
#: Steps of the search in a shard, over all branches, before it settles for the incumbent; None searches to the end.
STEPS = 100_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: containers as lists of indices."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        left, b = room.pop(at) if at < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        insort(room, (left - sizes[i], b))
    return bins


class Budget:
    """Steps that may still be taken; without a number of them, any."""

    def __init__(self, steps: int | None):
        self.left = steps

    def spent(self) -> bool:
        if self.left is None:
            return False
        self.left -= 1
        return self.left < 0


def fillings(rest: list[int], room: int, most_waste: int, budget: Budget, fair: int = 0) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` from the ascending sizes ``rest`` that leaves ``most_waste`` empty at most, until the budget ends: first those that leave ``fair``, a container's even share of the waste, then those of eight times that, then the others.

    Each step takes the largest item that fits, and branches on leaving out all of its size;
    branches that can't become full enough are left at once.
    """
    below = list(accumulate(rest, initial=0))
    available = Counter(rest)
    sizes = sum(1 << x for x in available)
    low = -1
    for high in sorted({min(fair, most_waste), min(8 * fair, most_waste), most_waste}):
        stack: list[tuple[tuple[int, ...], int, int]] = [((), room, len(rest))]
        while stack:
            if budget.spent():
                return
            taken, left, end = stack.pop()
            end = min(bisect_right(rest, left), end)
            if left - below[end] > high:
                continue
            if end == 0:
                if left > low and not _dominated(taken, left, available, sizes):
                    yield taken
                continue
            x = rest[end - 1]
            stack.append((taken, left, bisect_left(rest, x)))
            stack.append(((*taken, x), left - x, end - 1))
        low = high


def _dominated(taken: tuple[int, ...], left: int, available: Counter, sizes: int) -> bool:
    """Whether an item left out could take the place of some of the items taken (or of none) that together aren't larger; several may make way for one of the same size.

    Sums of items, and the sizes of what is left out, are sets of bits.
    """
    out = sizes
    for x, n in Counter(taken).items():
        if available[x] == n:
            out &= ~(1 << x)
    one, more = 0, 0
    for x in taken:
        more |= (more | one) << x
        one |= 1 << x
    if more & out:
        return True
    if not left:
        return False
    reach, width = one | more | 1, 0  # all sums plus 0 to width
    while width < left - 1:
        step = min(left - 1 - width, width + 1)
        reach |= reach << step
        width += step
    return bool(reach << 1 & out)


def bin_completion(sizes: list[int], capacity: int = CAPACITY, steps: int | None = STEPS) -> list[list[int]]:
    """Containers as lists of indices into ``sizes``, all of which are between 1 and the capacity."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(best) <= least:
        return best
    by_size: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        by_size.setdefault(sizes[i], []).append(i)
    rest = sorted(sizes)
    path: list[tuple[int, ...]] = []  # sizes in each container so far
    choices: list[Iterator[tuple[int, ...]]] = []
    wasted = [0]
    answer: list[tuple[int, ...]] | None = None
    count = len(best)
    budget = Budget(steps)

    def options() -> Iterator[tuple[int, ...]]:
        others, largest = rest[:-1], rest[-1]
        allowed = (count - 1) * capacity - total - wasted[-1]
        fair = max(0, allowed) // max(1, count - 1 - len(path))
        return ((largest, *f) for f in fillings(others, capacity - largest, min(allowed, capacity - largest), budget, fair)) if allowed >= 0 else iter(())

    choices.append(options())
    while choices and count > least:
        filling = next(choices[-1], None)
        if filling is None:
            choices.pop()
            if path:
                for x in path.pop():
                    insort(rest, x)
                wasted.pop()
            continue
        waste = wasted[-1] + capacity - sum(filling)
        if waste > (count - 1) * capacity - total:  # no better than the incumbent any more
            continue
        if len(filling) == len(rest):
            answer, count = [*path, filling], len(path) + 1
            continue
        for x in filling:
            rest.pop(bisect_left(rest, x))
        path.append(filling)
        wasted.append(waste)
        choices.append(options())
    if answer is None:
        return best
    return [[by_size[x].pop() for x in filling] for filling in answer]


def cut_points(text: str, capacity: int) -> list[tuple[int, int]]:
    """(start, length) in bytes of pieces within the capacity, each cut after the last line end, else the last space, of its final thirty-second part, else after a whole character."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while len(raw) - at > capacity:
        end = at + capacity
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        near = max(at + 1, end - capacity // 32)
        natural = max(raw.rfind(b"\n", near, end), -1) + 1 or raw.rfind(b" ", near, end) + 1
        end = natural or end
        out.append((at, end - at))
        at = end
    out.append((at, len(raw) - at))
    return out


CUTS = T.ArrayType(T.StructType([T.StructField("byte_start", T.LongType()), T.StructField("size", T.LongType())]))


def items(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(``key``, piece_index, piece_total, byte_start, size): one row for each row within the capacity, else one for each piece."""
    if capacity < 4:
        raise ValueError("a container must hold any character")

    @F.pandas_udf(CUTS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"byte_start": a, "size": n} for a, n in cut_points(t, capacity)])

    size = size_tokens(F.col(text))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("byte_start"), size.alias("size")))
    # as nondeterministic, the function isn't pulled into filters and runs once
    cuts = df.select(key, F.coalesce(cut.asNondeterministic()(F.when(size > capacity, F.col(text))), whole).alias("_cuts"))
    return cuts.select(key, F.posexplode("_cuts").alias("piece_index", "_cut"), F.size("_cuts").alias("piece_total")).select(key, "piece_index", "piece_total", "_cut.byte_start", "_cut.size")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, steps: int | None = STEPS) -> DataFrame:
    """One row for each item with its ``container``: (``key``, piece_index, piece_total, byte_start, size, container).

    A row is cut only if it is larger than a container. Null and empty texts take no room
    and come out with a null container. Rows that repeat a key, or have none, are items of
    their own. Texts are read once, for their sizes and cuts, which are checkpointed; the
    number of shards follows from their total size and number, and items are dealt to them
    by row, whatever their keys, so that no shard grows with the data or with a hot key.
    """
    parts = checkpointed(items(df, key, text, capacity).withColumn("_row", F.monotonically_increasing_id()))
    counted = parts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.count_if(F.col("size") > 0).alias("rows")).first()
    shards = max(1, -(-counted["tokens"] // shard_tokens), -(-counted["rows"] // shard_rows))
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("piece_index", T.IntegerType()), T.StructField("piece_total", T.IntegerType()), T.StructField("byte_start", T.LongType()), T.StructField("size", T.LongType()), T.StructField("container", T.LongType())])

    def fill(ids: tuple[pa.Scalar, ...], shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([(key, "ascending"), ("byte_start", "ascending"), ("_row", "ascending")])
        container = [0] * shard.num_rows
        for number, chosen in enumerate(bin_completion(shard.column("size").to_pylist(), capacity, steps)):
            for i in chosen:
                container[i] = (ids[0].as_py() << 32) + number
        return shard.drop_columns(["_shard", "_row"]).append_column("container", pa.array(container, pa.int64())).select([f.name for f in schema])

    dealt = parts.where("size > 0").withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    # so many partitions that the search runs in parallel: by their bytes alone, which are few, shards would be put together
    packed = dealt.repartition(min(shards, MAX_TASKS), "_shard").groupBy("_shard").applyInArrow(fill, schema)
    return packed.unionByName(parts.where("size = 0").drop("_row").withColumn("container", F.lit(None).cast("bigint")))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, items, filled, left_empty) of ``pack``'s result."""
    return packed.where("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("items"), F.sum("size").alias("filled")).withColumn("left_empty", F.lit(capacity) - F.col("filled"))


def packed_texts(packed: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pack``'s rows with the text of each item: one join on the key, which must be unique in ``df``. Null texts stay null."""
    texts = df.select(F.col(key).alias("_key"), F.encode(text, "UTF-8").alias("_bytes"))
    cut = F.expr("decode(substring(_bytes, cast(byte_start + 1 AS int), cast(size AS int)), 'UTF-8')")
    return packed.join(texts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(text, cut).drop("_key", "_bytes")
