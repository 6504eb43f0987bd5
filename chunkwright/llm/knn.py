"""Problem 3: the most similar vectors for every vector.

Shifted space-filling curves: each curve projects the unit vectors on some random orthogonal
directions, shifts them, and orders them along a Hilbert curve. Each curve is cut into
tiles, which also get the rows on either side that their windows reach; in each tile, blocks
of neighbouring rows are compared with what lies around them by a matrix product, and the
lists that a row gets from the curves are merged into one. Work is rows x curves x window.
How many curves and how wide a window the wanted recall takes depends on the vectors, so it
is measured: a bounded sample is searched exactly among all rows, and the places of what it
finds tell which curves and windows bring it together at the least work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chunkwright.functions.vector import is_usable
from chunkwright.session import checkpointed

K = 10
DIMENSIONS = 64
#: Share of the true neighbours that the windows are fitted to find, the rows of the sample that they are fitted with, and the most curves.
RECALL = 0.94
FIT_ROWS = 512
MOST_CURVES = 12
#: For pairs of high cosine: curves up to CURVE_ROWS vectors, and rows on either side; beyond, the number of curves grows as the rows to the power 0.22, which holds the chance that one of them brings two vectors of cosine 0.9 together.
CURVES = 12
CURVE_ROWS = 200_000
MARGIN = 3072
#: Rows compared at a time.
BLOCK = 1024
#: A tile has this many margins of rows, at least TILE_ROWS; a curve has up to MOST_TILES.
TILE = 8
TILE_ROWS = 16_384
MOST_TILES = 1000
#: Equal parts of a curve whose bounds are known, and the accuracy they are taken with.
PARTS = 4000
ACCURACY = 80_000
#: Directions that a curve runs through, and bits for each; the rest of a place is a hash of the key, so that many equal vectors needn't share a tile.
DIRECTIONS = 12
BITS = 4
HASHES = 15
#: Half-precision vectors are good for cosines to this error; closer to a threshold, the stored vectors decide.
HALF_ERROR = 0.001
#: So many undecided pairs at most are broadcast to the vectors; more are joined by shuffle.
BROADCAST_PAIRS = 100_000


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each column of integer coordinates (directions x rows), by Skilling's transform (2004)."""
    x = cells.astype(np.int64)
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << bits - 1
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def unit_vectors(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, rows they stand in) of those of the right length whose numbers are all finite and not all zero."""
    counts = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(counts == dimensions)
    x = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # nulls inside become NaN
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x = x[good]
    x /= np.abs(x).max(1, keepdims=True, initial=0) if len(x) else 1  # for squares of very large or small numbers
    return x / np.sqrt((x * x).sum(1, keepdims=True)), right[good]


def unit_array(codes: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of half-precision codes."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.float16).reshape(-1, dimensions).astype(np.float32)


def curve_frames(dimensions: int, curves: int, seed: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Axes and shifts of each curve; more curves begin with the same ones."""
    rng = np.random.default_rng(seed)
    directions = min(DIRECTIONS, dimensions)
    return [(np.linalg.qr(rng.standard_normal((dimensions, directions)))[0], rng.random(directions)) for _ in range(curves)]


def curve_places(x: np.ndarray, axes: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Places of unit vectors on one curve, the bits of the hash still zero."""
    # a unit vector's coordinate has a deviation of 1 / sqrt(dimensions); the logistic curve spreads that evenly over 0 to 1
    even = 1 / (1 + np.exp(-1.702 * math.sqrt(x.shape[1]) * (x @ axes)))
    cells = np.minimum(((even + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_place(cells.T, BITS) << HASHES


def places_arrow(batches: Iterator[pa.RecordBatch], dimensions: int, curves: int) -> Iterator[pa.RecordBatch]:
    """(curve, place, key, code) for each usable (key, embedding, hash) and curve; code is the unit vector in half precision."""
    frames = curve_frames(dimensions, curves)
    for batch in batches:
        x, rows = unit_vectors(batch.column(1), dimensions)
        if not len(x):
            continue
        at = pa.array(rows)
        keys, low = batch.column(0).take(at), batch.column(2).take(at).to_numpy()
        half = x.astype(np.float16)
        x = half.astype(np.float64)  # what is fitted from the codes must fall on the same places
        codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dimensions * 2), len(half), [None, pa.py_buffer(half.tobytes())]).cast(pa.binary())
        for c, (axes, shift) in enumerate(frames):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(curve_places(x, axes, shift) | low), keys, codes], names=["curve", "place", "key", "code"])


def best_in_block(block: np.ndarray, around: np.ndarray, own: int, k: int, lowest: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the block, row of ``around``, cosine) of the ``k`` most similar for each row, best first, with a cosine of ``lowest`` at least; the block itself begins at ``own`` in ``around``.

    A few rows at a time, so that their products stay in the processor's cache. The k-th
    largest of the maxima of groups of columns is a bound that k values at least reach.
    """
    columns, width = len(around), 64
    few = max(1, min(128, (1 << 22) // max(1, columns)))
    k = min(k, columns - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    other = np.ascontiguousarray(around.T)
    found = []
    for at in range(0, len(block), few):
        s = block[at : at + few] @ other
        rows = np.arange(len(s))
        s[rows, own + at + rows] = -2
        r = c = rows[:0]
        if lowest is not None:
            r, c = np.divmod(np.flatnonzero(s >= lowest), columns)
        elif columns >= 4 * k * width:
            tops = s[:, : columns // width * width].reshape(len(s), width, -1).max(1)
            least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            r, c = np.divmod(np.flatnonzero(s >= least[:, None]), columns)
        if lowest is None and (not len(r) or len(r) > 16 * k * len(s)):  # few columns, or many ties
            c = np.argpartition(-s, k - 1, axis=1)[:, :k].ravel()
            r = np.repeat(rows, k)
        v = s[r, c]
        order = np.lexsort((-v, r))
        r, c, v = r[order], c[order], v[order]
        keep = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (v > -2)
        found.append((r[keep] + at, c[keep], v[keep]))
    r, c, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return r, c, v


def fitted_windows(rows: DataFrame, k: int, dimensions: int, recall: float = RECALL) -> tuple[int, int]:
    """(curves, margin) of the least work that bring ``recall`` of the true neighbours of FIT_ROWS rows, the least by hash of their keys, into one window.

    The sample is searched exactly, all other rows going by once; then all rows are counted
    between the places of the sample and of what was found. Of the rows, only the sample
    and its neighbours go to the driver.
    """
    usable = rows.where(is_usable(F.col("vector"), dimensions)).orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).collect()
    if not usable:
        return 1, 1
    asked = np.array([r["vector"] for r in usable], np.float64)
    asked /= np.abs(asked).max(1, keepdims=True)
    asked /= np.sqrt((asked * asked).sum(1, keepdims=True))
    ids = [r["key"] for r in usable]
    kind = to_arrow_type(rows.schema["key"].dataType)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty(0, [("i", np.int32), ("cosine", np.float32), ("code", f"V{dimensions * 2}")])
        own = pa.array(ids, kind)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x, places = unit_vectors(batch.column(1), dimensions)
                if not len(x):
                    continue
                s = (asked @ x.T).astype(np.float32)
                same = pa.compute.index_in(batch.column(0).take(pa.array(places)), value_set=own).fill_null(-1).to_numpy()
                s[same[same >= 0], np.flatnonzero(same >= 0)] = -2
                few = min(k, s.shape[1])
                c = np.argpartition(-s, few - 1, axis=1)[:, :few]
                new = np.empty(c.size, best.dtype)
                new["i"], new["cosine"] = np.repeat(np.arange(len(s), dtype=np.int32), few), np.take_along_axis(s, c, 1).ravel()
                new["code"] = x.astype(np.float16).view(f"V{dimensions * 2}").ravel()[c.ravel()]
                best = np.concatenate((best, new[new["cosine"] > -2]))
                order = np.lexsort((-best["cosine"], best["i"]))
                best = best[order]
                best = best[np.arange(len(best)) - np.searchsorted(best["i"], best["i"]) < k]
        yield pa.RecordBatch.from_arrays([pa.array(best["i"]), pa.array(best["cosine"]), pa.array([v.tobytes() for v in best["code"]], pa.binary())], names=["i", "cosine", "code"])

    first = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cosine"), "code"))
    true = rows.select("key", "vector").mapInArrow(exact, "i int, cosine float, code binary").withColumn("n", first).where(F.col("n") <= k).select("i", "code").collect()
    if not true:
        return 1, 1
    found = np.frombuffer(b"".join(r["code"] for r in true), np.float16).reshape(-1, dimensions).astype(np.float64)
    source = asked.astype(np.float16).astype(np.float64)
    of = np.array([r["i"] for r in true])
    frames = curve_frames(dimensions, MOST_CURVES)
    from_to = [(curve_places(source, *f)[of] >> HASHES, curve_places(found, *f) >> HASHES) for f in frames]
    cuts = [np.unique(np.concatenate(p)) for p in from_to]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for batch in batches:
            x = unit_vectors(batch.column(0), dimensions)[0].astype(np.float16).astype(np.float64)
            for total, cut, frame in zip(totals, cuts, frames, strict=True):
                total += np.bincount(np.searchsorted(cut, curve_places(x, *frame) >> HASHES), minlength=len(total))
        for c, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["curve", "at", "n"])

    between = [np.zeros(len(c) + 1, np.int64) for c in cuts]
    for r in rows.select("vector").mapInArrow(counted, "curve int, at int, n bigint").groupBy("curve", "at").agg(F.sum("n").alias("n")).collect():
        between[r["curve"]][r["at"]] = r["n"]
    apart = np.empty((MOST_CURVES, len(of)), np.int64)
    for c, (a, b) in enumerate(from_to):
        upto = np.cumsum(between[c])  # rows whose place isn't beyond the cut
        a, b = np.searchsorted(cuts[c], a), np.searchsorted(cuts[c], b)
        apart[c] = np.where(a == b, 0, upto[np.maximum(a, b)] - upto[np.minimum(a, b)])
    nearest_apart = np.minimum.accumulate(apart, axis=0)
    margins = [int(np.quantile(d, recall, method="higher")) for d in nearest_apart]
    best = min(range(MOST_CURVES), key=lambda c: (c + 1) * (2 * margins[c] + BLOCK))
    return best + 1, max(1, margins[best])


def tile_bounds(placed: DataFrame, margin: int) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(tiles of a curve, for each curve): where its tiles begin, and the first place and the end of what each gets, ``margin`` rows more on either side at least."""
    quantiles = F.percentile_approx("place", [i / PARTS for i in range(PARTS + 1)], ACCURACY)
    found = placed.groupBy("curve").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), quantiles.alias("q")).collect()
    n = max((r["n"] for r in found), default=0)
    tiles = max(1, min(MOST_TILES, n // max(TILE * margin, TILE_ROWS)))
    more = math.ceil((margin / max(n, 1) + 2 / ACCURACY) * PARTS) + 1
    bounds = {}
    for r in found:
        cuts = [round(t * PARTS / tiles) for t in range(tiles + 1)]
        at = lambda i, r=r: r["low"] if i <= 0 else r["high"] + 1 if i >= PARTS else r["q"][i]
        bounds[r["curve"]] = tuple(np.array(x, np.int64) for x in ([at(a) for a in cuts[:-1]], [at(a - more) for a in cuts[:-1]], [at(z + more) for z in cuts[1:]]))
    return tiles, bounds


def tiles_arrow(batches: Iterator[pa.RecordBatch], tiles: int, bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(tile, own, place, key, code) of (curve, place, key, code): each row in its own tile and in those whose windows reach it; tiles are numbered over all curves."""
    for batch in batches:
        curves, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for c in np.unique(curves):
            begin, first, end = bounds[int(c)]
            at = np.flatnonzero(curves == c)
            own = np.searchsorted(begin, place[at], "right") - 1
            low, high = np.searchsorted(end, place[at], "right"), np.searchsorted(first, place[at], "right")
            low, high = np.minimum(low, own), np.maximum(high, own + 1)
            times = high - low
            rows = np.repeat(np.arange(len(at)), times)
            tile = low[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(at[rows])
            yield pa.RecordBatch.from_arrays([pa.array((c * tiles + tile).astype(np.int32)), pa.array(tile == own[rows]), *[batch.column(i).take(take) for i in (1, 2, 3)]], names=["tile", "own", "place", "key", "code"])


def windows_arrow(batches: Iterator[pa.RecordBatch], dimensions: int, k: int, margin: int, lowest: float | None = None) -> Iterator[pa.RecordBatch]:
    """(key, near, cosine) with lists of up to ``k`` for each own row of a tile sorted by place; holds a block and its margins at a time. With ``lowest``, rows that find nothing as similar are left out."""
    x, own, keys, at = np.empty((0, dimensions), np.float32), np.empty(0, bool), None, 0

    def step(to: int) -> Iterator[pa.RecordBatch]:
        mine = np.flatnonzero(own[at:to]) + at
        if not len(mine):
            return
        a, z = int(mine[0]), int(mine[-1]) + 1  # own rows stand together
        low = max(0, a - margin)
        r, c, v = best_in_block(x[a:z], x[low : z + margin], a - low, k, lowest)
        if lowest is not None:
            rows, r = np.unique(r, return_inverse=True)
            ends = np.searchsorted(r, np.arange(len(rows) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows + a)), pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array(c + low))), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.float32)))], names=["key", "near", "cosine"])
            return
        ends = np.searchsorted(r, np.arange(z - a + 1)).astype(np.int32)
        near = keys.take(pa.array(c + low))
        yield pa.RecordBatch.from_arrays([keys.slice(a, z - a), pa.ListArray.from_arrays(pa.array(ends), near), pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.float32)))], names=["key", "near", "cosine"])

    for part in batches:
        if not part.num_rows:
            continue
        x = np.concatenate((x, unit_array(part.column(4), dimensions)))
        own = np.concatenate((own, part.column(1).to_numpy(zero_copy_only=False)))
        keys = part.column(3) if keys is None else pa.concat_arrays([keys, part.column(3)])
        while len(x) >= at + BLOCK + margin:
            yield from step(at + BLOCK)
            at += BLOCK
        if at > margin:
            x, own, keys, at = x[at - margin :], own[at - margin :], keys.slice(at - margin), margin
    while at < len(x):
        to = min(at + BLOCK, len(x))
        yield from step(to)
        at = to


def merge_arrow(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(key, neighbour, cosine, rank): of (key, near, cosine) sorted by key, the best ``k`` of all lists of a key, each neighbour once."""

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        parent = batch.column(1).value_parent_indices() if hasattr(pa.ListArray, "value_parent_indices") else pa.compute.list_parent_indices(batch.column(1))
        owner, near = batch.column(0).take(parent), batch.column(1).flatten()
        codes = pa.concat_arrays([owner, near]).dictionary_encode().indices.to_numpy()
        a, b = codes[: len(owner)].astype(np.int64), codes[len(owner) :].astype(np.int64)
        v = batch.column(2).flatten().to_numpy()
        order = np.lexsort((-v, b, a))
        a, b, v = a[order], b[order], v[order]
        fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) & (a != b) if len(a) else np.empty(0, bool)
        a, v, order = a[fresh], v[fresh], order[fresh]
        best = np.lexsort((-v, a))
        a, v, order = a[best], v[best], order[best]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        keep = nth < k
        rows = pa.array(order[keep])
        return pa.RecordBatch.from_arrays([owner.take(rows), near.take(rows), pa.array(v[keep]), pa.array((nth[keep] + 1).astype(np.int32))], names=["key", "neighbour", "cosine", "rank"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        last = batch.column(0)[batch.num_rows - 1]
        same = pa.compute.equal(batch.column(0), last).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))  # rows of the last key may go on in the next batch
        if cut:
            yield merged(batch.slice(0, cut))
        held = batch.slice(cut)
    if held is not None:
        yield merged(held)


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))


def _lists(rows: DataFrame, k: int, dimensions: int, curves: int, margin: int, lowest: float | None = None) -> DataFrame:
    """(key, near, cosine): what each row finds in its window of each curve."""
    kind = rows.schema["key"].dataType
    hashed = rows.withColumn("hash", F.pmod(F.xxhash64("key"), F.lit(1 << HASHES)))
    placed = hashed.mapInArrow(lambda b: places_arrow(b, dimensions, curves), T.StructType([T.StructField("curve", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("key", kind), T.StructField("code", T.BinaryType())]))
    tiles, bounds = tile_bounds(placed, margin)
    tiled = placed.mapInArrow(lambda b: tiles_arrow(b, tiles, bounds), T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("own", T.BooleanType()), *placed.schema.fields[1:]]))
    ranged = tiled.repartitionById(curves * tiles, "tile").sortWithinPartitions("place", "key")
    return ranged.mapInArrow(lambda b: windows_arrow(b, dimensions, k, margin, lowest), T.StructType([T.StructField("key", kind), T.StructField("near", T.ArrayType(kind)), T.StructField("cosine", T.ArrayType(T.FloatType()))]))


def nearest(df: DataFrame, key: str = "chunk_no", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, curves: int | None = None, margin: int | None = None, recall: float = RECALL) -> DataFrame:
    """(key, neighbour, cosine, rank): up to ``k`` most similar other rows for every usable row.

    Usable are vectors of ``dimensions`` finite numbers that aren't all zero, of any norm;
    other rows (null vectors and keys too) take no part. Cosines are of vectors in half
    precision. Rows of equal vectors are neighbours like others; where more tie than fit,
    any of them come out. Rows that share a key are one row with several vectors. Fewer than
    two usable rows give nothing. Curves and margin are fitted to ``recall`` on a sample
    unless they are given; the result doesn't depend on the number of partitions.
    """
    rows = _rows(df, key, vector)
    if curves is None or margin is None:
        fitted = fitted_windows(rows, k, dimensions, recall)
        curves, margin = curves or fitted[0], margin or fitted[1]
    kind = rows.schema["key"].dataType
    lists = _lists(rows, k, dimensions, curves, margin)
    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: merge_arrow(b, k), T.StructType([T.StructField("key", kind), T.StructField("neighbour", kind), T.StructField("cosine", T.FloatType()), T.StructField("rank", T.IntegerType())]))


def similar_pairs(df: DataFrame, threshold: float, key: str = "chunk_no", vector: str = "embedding", k: int = K, dimensions: int = DIMENSIONS, curves: int | None = None, margin: int = MARGIN) -> DataFrame:
    """(a, b), a < b: pairs with a cosine of ``threshold`` at least, the ``k`` most similar of each row on each curve among them; those too close to the threshold for half precision are decided by the stored vectors.

    The margin stays as it is at any number of rows: what holds the recall of high cosines
    is the number of curves, which grows slowly. What is less similar never leaves its task.
    """
    rows = _rows(df, key, vector)
    if curves is None:
        curves = max(CURVES, math.ceil(CURVES * (rows.count() / CURVE_ROWS) ** 0.22))
    lists = _lists(rows, k, dimensions, curves, margin, threshold - HALF_ERROR)
    found = lists.select("key", F.explode(F.arrays_zip("near", "cosine")).alias("_n")).select("key", F.col("_n.near").alias("neighbour"), F.col("_n.cosine").alias("cosine")).where("key != neighbour")
    pairs = found.groupBy(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b")).agg(F.max("cosine").alias("cosine"))
    pairs = checkpointed(pairs)
    clear = pairs.where(F.col("cosine") > threshold + HALF_ERROR).select("a", "b")
    unclear = pairs.where(F.col("cosine") <= threshold + HALF_ERROR).select("a", "b")
    few = unclear.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    side = lambda x: F.broadcast(x) if few else x
    vectors = df.select(F.col(key).alias("_key"), F.transform(vector, lambda v: v.cast("double")).alias("_v"))
    wanted = side(unclear.select(F.explode(F.array("a", "b")).alias("_key")).distinct())
    known = vectors.join(wanted, "_key", "left_semi")
    both = known.select(F.col("_key").alias("b"), F.col("_v").alias("_vb")).join(side(unclear), "b").join(known.select(F.col("_key").alias("a"), F.col("_v").alias("_va")), "a")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = dot("_va", "_vb") / F.sqrt(dot("_va", "_va")) / F.sqrt(dot("_vb", "_vb"))
    return clear.unionByName(both.where(cosine >= threshold).select("a", "b"))
