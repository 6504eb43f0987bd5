"""Problem 1: splitting oversized items at natural boundaries.

Agglomerative merging: a text starts as atomic segments (words with the white space behind
them, unbroken runs cut between graphemes); the boundaries between neighbours lie in a heap
and the weakest one whose neighbours fit together is merged first, until no two neighbours
fit. What remains between pieces are the strongest boundaries that could be kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.functions.text import size_tokens
from chunkwright.operators.positions import with_offsets
from chunkwright.session import checkpointed

LIMIT = 1600
OVERLAP = 200

#: The longest UTF-8 character, less one: what an overlap may be longer than asked, to begin with a whole character.
SLACK = 3

WORD = regex.compile(r"\S*\s+|\S+\z")
GRAPHEME = regex.compile(r"\X")
# How a segment ends, from the strongest boundary to the weakest.
ENDINGS = tuple(
    (strength, regex.compile(pattern))
    for strength, pattern in ((5, r"\n[^\S\n]*\n\s*\z"), (4, r"[\n\v\f\x85  ]\s*\z"), (3, r"[.!?…]['\")\]»”’]*\s+\z|[。！？]['\")\]»”’」』]*\s*\z"), (2, r"[,;:–—]\s+\z|[、，；：]\s*\z"), (1, r"\s\z"))
)


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def atoms(text: str, largest: int) -> list[tuple[str, int]]:
    """Atomic segments of at most ``largest`` bytes that make up the text, each with the strength of the boundary behind it."""
    out: list[tuple[str, int]] = []
    for m in WORD.finditer(text):
        word = m[0]
        strength = next((s for s, p in ENDINGS if p.search(word)), 0)
        if _size(word) > largest:
            run, used = [], 0
            for part in (c for g in GRAPHEME.findall(word) for c in ([g] if _size(g) <= largest else g)):
                if used + _size(part) > largest:
                    piece = "".join(run)
                    out.append((piece, 1 if piece[-1].isspace() else 0))
                    run, used = [], 0
                run.append(part)
                used += _size(part)
            word = "".join(run)
        out.append((word, strength))
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces as (where the piece begins, where what it adds begins, where it ends), in characters.

    A piece is at most ``limit`` bytes. Every piece but the first begins ``overlap`` bytes
    (up to three more, for a whole character) before the end of the one before it. What the
    pieces add, joined, is the text.
    """
    if limit - overlap - SLACK < 8 or overlap < 0:
        raise ValueError("the limit must exceed the overlap by 11 at least")
    if _size(text) <= limit:
        return [(0, 0, len(text))]
    room = limit - overlap - SLACK if overlap else limit
    parts = atoms(text, max(4, min(room, room // 16)))
    sizes = [_size(a) for a, _ in parts]
    ends = [len(a) for a, _ in parts]
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    # an entry is stale when a side has grown since; sizes only grow, so what doesn't fit now never will
    heap = [(parts[i][1], sizes[i] + sizes[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    strength = [s for _, s in parts]
    while heap:
        _, both, i, j = heapq.heappop(heap)
        if not alive[i] or after[i] != j or sizes[i] + sizes[j] != both:
            continue
        if both > (limit if i == 0 else room):
            continue
        sizes[i], ends[i], strength[i], alive[j] = both, ends[i] + ends[j], strength[j], False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strength[i], both + sizes[after[i]], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[before[i]], sizes[before[i]] + both, before[i], i))
    pieces, at, i = [], 0, 0
    while i < n:
        start, shared = at, 0
        while at and shared < overlap and start > 0:
            start -= 1
            shared += _size(text[start])
        pieces.append((start, at, at + ends[i]))
        at += ends[i]
        i = after[i]
    return pieces


PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("piece_start", T.IntegerType()), T.StructField("added_start", T.IntegerType())]))


def split_oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Every row once for each piece of its text, with ``piece_index``, ``piece_total``, ``piece_start`` and ``added_start`` (characters into the whole text).

    Rows within the limit (null and empty texts too) come out as they are, as piece 0 of 1,
    without being sent to Python; the table is read once. All other columns are kept on every piece; columns that
    are already called like the four new ones are replaced. Repeated rows are split alike.
    """
    new = ("piece_index", "piece_total", "piece_start", "added_start")
    df = df.drop(*new)

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"text": t[a:z], "piece_start": a, "added_start": b} for a, b, z in split_text(t, limit, overlap)])

    large = size_tokens(F.col(text)) > limit
    whole = F.array(F.struct(F.col(text).alias("text"), F.lit(0).alias("piece_start"), F.lit(0).alias("added_start")))
    # as nondeterministic, the function isn't pulled into filters and runs once
    pieces = df.withColumn("_pieces", F.coalesce(cut.asNondeterministic()(F.when(large, F.col(text))), whole))
    pieces = pieces.select("*", F.posexplode("_pieces").alias("_i", "_piece"))
    return pieces.select(*[F.col("_piece.text").alias(text) if c == text else F.col(f"`{c}`") for c in df.columns], F.col("_i").alias(new[0]), F.size("_pieces").alias(new[1]), F.col("_piece.piece_start").alias(new[2]), F.col("_piece.added_start").alias(new[3]))


def split_chunks(chunks: DataFrame, key: str = "chunk_no", group: Sequence[str] = ("source_document", "section_path"), limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``split_oversized`` with ``chunk_index`` and ``chunk_total`` counted anew in every group, over all pieces, in the order of the old index and ``key``.

    Groups of any size: only keys are sorted, by range, and texts don't move for the
    counting but for one join on ``key``. Rows that repeat a key are taken as one for the
    counting, so their pieces share numbers. Null groups and indices are groups and come first.
    """
    pieces = split_oversized(chunks, limit=limit, overlap=overlap)
    counted = checkpointed(pieces.where("piece_index = 0").select(key, *group, "chunk_index", "piece_total"))
    rows = counted.groupBy(key, *group).agg(F.min("chunk_index").alias("chunk_index"), F.max("piece_total").alias("_pieces"))
    placed = with_offsets(rows, list(group), ["chunk_index", key], F.col("_pieces"), "_offset", "_total")
    placed = placed.select(F.col(key).alias("_key"), *[F.col(g).alias(f"_in{i}") for i, g in enumerate(group)], "_offset", "_total")
    same = F.col(key).eqNullSafe(F.col("_key"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_in{i}"))
    numbered = pieces.join(placed, same)
    return numbered.withColumn("chunk_index", (F.col("_offset") + F.col("piece_index")).cast("int")).withColumn("chunk_total", F.col("_total").cast("int")).drop("_key", "_offset", "_total", *[f"_in{i}" for i in range(len(group))])
