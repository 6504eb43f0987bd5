"""A retrieval service over a chunk store: index, search, cite, delete, clear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from chunkwright.operators.chunking import Tokenizer, chunk_sections, piece_tokenizer
from chunkwright.operators.embed import Embedder, embed_chunks, embed_queries, hashing_embedder
from chunkwright.operators.layout import format_sections, page_texts
from chunkwright.operators.outline import outline_sections
from chunkwright.operators.rerank import Judge, overlap_score
from chunkwright.plans.search import contexts, search
from chunkwright.schema import Config
from chunkwright.session import checkpointed
from chunkwright.sources.pdf import OutlineParser, Parser, bookmarks_of, pdf_parser, scan, words_of
from chunkwright.sources.store import ChunkStore

#: Words to sections.
Strategy = Callable[[DataFrame], DataFrame]


class RetrievalService:
    """Ties a store, a parser, a strategy, an embedder and a reranker together."""

    def __init__(self, store: ChunkStore, config: Config = Config(), parser: Parser = pdf_parser, strategy: Strategy | None = None, embedder: Callable[[], Embedder] | None = None, score: Callable[[Column, Column], Column] = overlap_score, tokenizer: Tokenizer = piece_tokenizer, judged_by: Callable[[], Judge] | None = None, outline: OutlineParser | None = None, root: str | None = None):
        """``strategy`` makes sections of words. With ``outline``, sections follow the files' bookmarks instead; a file without any gets its sections by ``strategy``. ``root`` is where relative paths begin."""
        self.store, self.config, self.parser, self.score, self.tokenizer, self.judged_by, self.outline, self.root = store, config, parser, score, tokenizer, judged_by, outline, root
        self.strategy = strategy or (lambda words: format_sections(words, config.max_heading_depth))
        dimensions = config.vector_size
        self.embedder = embedder or (lambda: hashing_embedder(dimensions))
        store.create()

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def index(self, paths: str | list[str], glob: str = "*") -> int:
        """Indexes files, all in one distributed pass, replacing what they had; gives the number of chunks."""
        files = scan(self.spark, paths, glob, self.root)
        words = words_of(files, self.parser)
        chunks = chunk_sections(self.sections(files, words), self.config.max_chunk_tokens, self.config.chunk_overlap_tokens, self.tokenizer)
        return self.store.replace(embed_chunks(chunks, self.embedder, self.config.embedding_batch))

    def sections(self, files: DataFrame, words: DataFrame) -> DataFrame:
        """Sections of files and their words."""
        if self.outline is None:
            return self.strategy(words)
        bookmarks = checkpointed(bookmarks_of(files, self.outline))
        marked = bookmarks.select("document").distinct()
        words = checkpointed(words)
        by_outline = outline_sections(bookmarks, page_texts(words.join(marked, "document", "left_semi")), self.config.max_heading_depth)
        return by_outline.unionByName(self.strategy(words.join(marked, "document", "left_anti")).select(*by_outline.columns))

    def search_table(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Results of a table of queries (query_id, text)."""
        asked = embed_queries(queries, self.embedder)
        return search(self.store.load(), asked, "id", self.config, k, self.score, self.config.vector_size, self.store.postings(), self.judged_by)

    def search(self, query: str, k: int | None = None) -> DataFrame:
        return self.search_table(self.spark.createDataFrame([(1, query)], "query_id bigint, text string"), k)

    def context(self, results: DataFrame) -> str:
        one = self.spark.createDataFrame([(1,)], "query_id bigint")
        return contexts(results, one).first()["context"]

    def delete(self, document: str) -> None:
        self.store.delete_document(document)

    def clear(self) -> None:
        self.store.clear()


class Tools:
    """The service's functions for a language model: text in, text out."""

    def __init__(self, service: RetrievalService):
        self.service = service

    def search_documents(self, query: str, k: int = 5) -> str:
        return self.service.context(self.service.search(query, k))

    def index_document(self, path: str) -> str:
        return self._told("index document", lambda: f"Indexed {path}: {self.service.index(path)} chunks.")

    def delete_document(self, name: str) -> str:
        return self._told("delete document", lambda: self.service.delete(name) or f"Deleted {name}.")

    def clear_index(self) -> str:
        return self._told("clear index", lambda: self.service.clear() or "Cleared the index.")

    @staticmethod
    def _told(what: str, action: Callable[[], str]) -> str:
        try:
            return action()
        except Exception as error:  # noqa: BLE001
            return f"Failed to {what}: {error}"
