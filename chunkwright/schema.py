"""Schemas of the tables and the settings of a retrieval pipeline."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T

_TEXT, _INT, _LONG, _DOUBLE, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CHUNK = _table(
    id=_TEXT, text=_TEXT, embedding=T.ArrayType(T.FloatType()), source_document=_TEXT, start_page=_INT, end_page=_INT,
    chunk_index=_INT, chunk_total=_INT, section=_TEXT, section_path=_TEXT, metadata=T.MapType(_TEXT, _TEXT),
)
SECTION = _table(
    document=_TEXT, section_ord=_INT, heading=_TEXT, heading_path=_TEXT, heading_font_size=_DOUBLE, heading_is_bold=_BOOL,
    level=_INT, start_page=_INT, end_page=_INT, page_texts=T.ArrayType(_table(page_number=_INT, text=_TEXT)),
)
WORD = _table(
    document=_TEXT, ord=_LONG, page=_INT, text=_TEXT, font_name=_TEXT, font_size=_DOUBLE, color_key=_TEXT,
    is_bold=_BOOL, is_italic=_BOOL, top=_DOUBLE, bottom=_DOUBLE,
)
BOOKMARK = _table(document=_TEXT, ord=_LONG, title=_TEXT, level=_INT, page=_INT, parent_titles=T.ArrayType(_TEXT))
TERM_STATS = _table(term=_TEXT, df=_LONG)
CORPUS_STATS = _table(total_docs=_LONG, total_len=_LONG)


class Scoring(Enum):
    """How the sparse branch weighs a term.

    LIVE_IDF: term frequency stored, inverse document frequency taken when searching, once,
    with a constant average length. CLASSIC: the same with the real average length.
    IDF_SQUARED: the query is weighed like a document, so the inverse document frequency
    counts twice.
    """

    LIVE_IDF = "live_idf"
    CLASSIC = "classic"
    IDF_SQUARED = "idf_squared"


@dataclass(frozen=True)
class Config:
    max_chunk_tokens: int = 400
    chunk_overlap_tokens: int = 50
    vector_size: int = 384
    dense_weight: float = 0.7
    k1: float = 1.2
    b: float = 0.75
    adjacent_chunks: int = 1
    top_k: int = 5
    retrieval_factor: int = 2
    minimum_relevance: float = 5.0
    embedding_batch: int = 50
    max_heading_depth: int = 2
    scoring: Scoring = Scoring.LIVE_IDF

    def __post_init__(self) -> None:
        if self.max_chunk_tokens <= 0:
            raise ValueError("a chunk must hold a token")
        if not 0 <= self.chunk_overlap_tokens < self.max_chunk_tokens:
            raise ValueError("the overlap must be less than a chunk")

    @property
    def sparse_weight(self) -> float:
        return 1 - self.dense_weight
