"""Token-bounded chunks of sections, with overlap and the pages each chunk comes from.

A section is cut in one pass over the places where its tokens end, so a token is counted
once and cuts are found by bisection instead of counting prefixes again and again. Sections
are independent rows: the work is parallel over sections and sequential inside one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.functions.text import has_ink, page_list

#: Tells where the tokens of a text end, ascending; the last end is the text's length.
Tokenizer = Callable[[str], list[int]]

SENTENCE_ENDS = ".!?"
WHITE = regex.compile(r"\s")
PIECE = regex.compile(r"\s*(?:[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{N}]+)|\s+")


def piece_tokenizer(text: str) -> list[int]:
    """Words, numbers of up to three digits and runs of signs, each with the white space before it."""
    return [m.end() for m in PIECE.finditer(text)]


def byte_tokenizer(text: str) -> list[int]:
    """Every UTF-8 byte is a token; a character's end stands as often as it has bytes."""
    return [i + 1 for i, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))]


class BpeTokenizer:
    """Tokens of a public byte-level vocabulary in a tiktoken file, loaded once in each worker."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    def __call__(self, text: str) -> list[int]:
        import base64

        import tiktoken

        if self._encoding is None:
            with open(self.path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        tokens = self._encoding.encode_ordinary(text)
        ends, at, raw = [], 0, 0
        starts = [0]
        for c in text:
            starts.append(starts[-1] + len(c.encode("utf-8", "surrogatepass")))
        for token in self._encoding.decode_tokens_bytes(tokens):
            raw += len(token)
            at = bisect_left(starts, raw)
            ends.append(at)
        return ends


def leading(text: str, count: int, tokenizer: Tokenizer) -> list[int]:
    """The ends of more than ``count`` tokens, or of all: a stretch of the text that doubles until it has enough, ended before white space, where tokens begin anew."""
    size = 8 * count + 256
    while size < len(text):
        space = WHITE.search(text, size)
        stop = space.start() if space else len(text)
        ends = tokenizer(text[:stop])
        if len(ends) > count or stop == len(text):
            return ends
        size *= 2
    return tokenizer(text)


def prefix_within(text: str, limit: int, tokenizer: Tokenizer) -> str:
    """The longest beginning of ``limit`` tokens, cut after the last sentence end of its final quarter if there is one; a character at least."""
    ends = leading(text, limit, tokenizer)
    fit = len(text) if len(ends) <= limit else ends[limit - 1] if limit > 0 else 0
    if not fit:
        return text[:1]
    stop = max(text.rfind(c, fit - fit // 4, fit) for c in SENTENCE_ENDS)
    return text[: stop + 1] if stop > 0 else text[:fit]


def overlap_of(text: str, tokens: int, tokenizer: Tokenizer) -> str:
    """The shortest tail of ``tokens`` tokens, from behind its last sentence end on if there is one; empty if the text has no more tokens than that."""
    ends = tokenizer(text)
    if tokens <= 0 or len(ends) <= tokens:
        return ""
    tail = text[ends[-tokens - 1] :]
    last = max((m.end() for m in regex.finditer(r"[.!?]\s", tail)), default=0)
    return tail[last:] if 0 < last < len(tail) else tail


def chunk_section(pages: list[tuple[int | None, str]], limit: int, overlap: int, tokenizer: Tokenizer) -> list[tuple[str, list[int]]]:
    """(text, pages) of a section's chunks: whole if it fits, else filled greedily page by page.

    A page joins an open chunk behind one space, which counts as a token. What doesn't fit is
    cut, and the next chunk begins with the overlap, which belongs to the last page so far.
    """
    whole = " ".join(text for _, text in pages)
    if not whole.strip():
        return []
    if len(leading(whole, limit, tokenizer)) <= limit:
        return [(whole, [p for p, _ in pages if p is not None])]
    out: list[tuple[str, list[int]]] = []
    text, used, on = "", 0, set()

    def flush() -> None:
        nonlocal text, used, on
        out.append((text.strip(), sorted(on)))
        text = overlap_of(text, overlap, tokenizer)
        used = len(tokenizer(text))
        on = {max(on)} if text and on else set()

    for number, content in pages:
        rest = content
        while rest:
            room = limit - used - bool(text)
            if room <= 0:
                before = text
                flush()
                if text and len(text) >= len(before):  # the overlap alone fills a chunk
                    text, used = "", 0
                continue
            ends = leading(rest, room, tokenizer)
            taken = rest if len(ends) <= room else prefix_within(rest, room, tokenizer)
            text += (" " if text else "") + taken
            if number is not None:
                on.add(number)
            if len(taken) < len(rest) or len(ends) > room:
                flush()
            else:
                used += len(ends) + (1 if len(text) > len(taken) else 0)
            rest = rest[len(taken) :]
    if text:
        out.append((text.strip(), sorted(on)))
    return out


CHUNKED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("pages", T.ArrayType(T.IntegerType()))]))


def chunk_sections(sections: DataFrame, limit: int = 400, overlap: int = 50, tokenizer: Tokenizer = piece_tokenizer) -> DataFrame:
    """Chunks of a table of sections, as (id, text, source_document, start_page, end_page, chunk_index, chunk_total, section, section_path, metadata, section_ord).

    Sections without pages or ink give no chunks; null page texts are empty. Indices and
    totals are counted in each section row. The id is the document, the first 15 digits of
    the path's MD5 (nosection where there is no path) and the index, so it is the same
    whenever a document is indexed again.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive and the overlap less than it")

    @F.pandas_udf(CHUNKED)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda pages: [{"text": t, "pages": p} for t, p in chunk_section([(x["page_number"], x["text"] or "") for x in (pages if pages is not None else [])], limit, overlap, tokenizer)])

    # an inner explode would infer a filter from the function's result and run it twice;
    # counting tokens takes far longer than moving the text, and files are skewed
    cut_rows = sections.repartition("document", "section_ord").withColumn("_chunks", cut(F.col("page_texts")))
    rows = cut_rows.select("document", "section_ord", "heading", "heading_path", "level", "start_page", "end_page", F.size("_chunks").alias("chunk_total"), F.posexplode_outer("_chunks").alias("chunk_index", "_chunk")).where("_chunk IS NOT NULL")
    pages = F.col("_chunk.pages")
    marker = F.when(F.coalesce(F.col("heading_path"), F.lit("")) == "", F.lit("nosection")).otherwise(F.conv(F.substring(F.md5("heading_path"), 1, 12), 16, 10))
    section = F.coalesce("heading", "document")
    return rows.select(
        F.concat_ws("_", F.coalesce("document", F.lit("")), F.lit("bookmark"), marker, F.lit("chunk"), F.col("chunk_index").cast("string")).alias("id"),
        F.col("_chunk.text").alias("text"), F.col("document").alias("source_document"),
        F.coalesce(F.array_min(pages), F.col("start_page")).alias("start_page"), F.coalesce(F.array_max(pages), F.col("end_page")).alias("end_page"),
        F.col("chunk_index").cast("int"), F.col("chunk_total").cast("int"), section.alias("section"), F.coalesce("heading_path", section).alias("section_path"),
        F.create_map(F.lit("ChunkType"), F.lit("Bookmark"), F.lit("BookmarkLevel"), F.col("level").cast("string"), F.lit("Pages"), page_list(pages)).alias("metadata"), "section_ord",
    )


def section_text(sections: DataFrame) -> DataFrame:
    """Sections with ``text``, the page texts in their order with a space between; pages without ink left out, and sections without any."""
    inked = F.filter("page_texts", lambda p: has_ink(p["text"]))
    return sections.withColumn("text", F.array_join(F.transform(inked, lambda p: p["text"]), " ")).where(F.size(inked) > 0)
