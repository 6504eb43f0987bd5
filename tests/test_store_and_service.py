import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.operators.bm25 import bm25_top_k
from chunkwright.operators.embed import pooled_embedder
from chunkwright.plans.search import NOTHING, contexts
from chunkwright.plans.service import RetrievalService, Tools
from chunkwright.schema import CHUNK, Config, Scoring
from chunkwright.sources.pdf import color_key_of, scan, text_outline, text_parser, words_of
from chunkwright.sources.store import ChunkStore, from_payload, to_payload, upserted
from chunkwright.streaming.incremental import upsert_stream


def chunk(i, text="t", document="d", **more):
    row = {"id": i, "text": text, "embedding": [1.0, 0.0], "source_document": document, "start_page": 1, "end_page": 2, "chunk_index": 0, "chunk_total": 1, "section": "s", "section_path": "p", "metadata": {"Pages": "1,2"}} | more
    return tuple(row[f.name] for f in CHUNK)


def texts(df):
    return {r["id"]: r["text"] for r in df.collect()}


def test_upsert_of_frames(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1), (None, 8, 1)], "id string, v int, _ord int")
    assert sorted((r["id"] or "", r["v"]) for r in upserted(old, new).collect()) == [("", 3), ("", 8), ("a", 1), ("b", 6), ("c", 7)]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "index"))
    assert store.load().count() == 0 and store.load().schema == CHUNK and store.version() is None
    store.create()
    store.upsert(spark.createDataFrame([chunk("a", "one"), chunk("b", "two", "e"), chunk("a", "three")], CHUNK).coalesce(1))
    assert texts(store.load()) == {"a": "three", "b": "two"}
    before = store.version()
    store.upsert(spark.createDataFrame([], CHUNK))
    assert store.version() == before
    store.upsert(spark.createDataFrame([chunk("b", "two again", "e"), chunk("c", None, None)], CHUNK))
    assert texts(store.load()) == {"a": "three", "b": "two again", "c": None}
    store.save_stats()
    terms, corpus = store.load_stats()
    assert {r["term"]: r["df"] for r in terms.collect()} == {"three": 1, "two": 1, "again": 1} and corpus.first()["total_docs"] == 2
    store.delete_document("e")
    assert texts(store.load()) == {"a": "three", "c": None}
    store.append(spark.createDataFrame([chunk("a", "three")], CHUNK))
    assert store.load().count() == 3
    store.export_json(str(tmp_path / "json"))
    other = ChunkStore(spark, str(tmp_path / "other"))
    other.import_json(str(tmp_path / "json"))
    assert other.load().count() == 3
    store.clear()
    assert store.load().count() == 0


def files(path):
    return {p for p in path.rglob("*.parquet") if "current" not in str(p)}


def test_changes_write_only_what_they_touch(spark, tmp_path):
    path = tmp_path / "index"
    store = ChunkStore(spark, str(path))
    store.upsert(spark.createDataFrame([chunk(f"{d}{i}", f"{d} text {i}", d) for d in "abcd" for i in range(3)], CHUNK))
    first = {p for p in files(path / "data")}
    store.upsert(spark.createDataFrame([chunk("b1", "new", "b"), chunk("e0", "more", "e")], CHUNK))
    added = files(path / "data") - first
    assert {p.parent.name for p in added} == {"source_document=b", "source_document=e"} and first <= files(path / "data")
    assert texts(store.load()) == {f"{d}{i}": f"{d} text {i}" for d in "abcd" for i in range(3)} | {"b1": "new", "e0": "more"}
    before = files(path / "data")
    store.delete_document("a")
    assert files(path / "data") == before and store.load().where("source_document = 'a'").count() == 0
    store.append(spark.createDataFrame([chunk("x", "late", "c"), chunk("y", "later", None)], CHUNK))
    assert {p.parent.name for p in files(path / "data") - before} == {"source_document=c", "source_document=__HIVE_DEFAULT_PARTITION__"}
    everything = texts(store.load())
    store.compact()
    assert texts(store.load()) == everything and len({p.parent.parent for p in files(path / "data")}) > 1  # the version before stays
    store.clear()
    store.clear()
    assert not files(path / "data") and store.load().count() == 0


@pytest.mark.parametrize("frozen", [False, True])
def test_stored_postings_answer_as_the_texts_do(spark, tmp_path, frozen):
    rows = [chunk(f"{i:03}", " ".join("abcdefgh"[j] for j in range(8) if i >> j & 1) or None, f"d{i % 5}") for i in range(120)]
    store = ChunkStore(spark, str(tmp_path / "index"), frozen=frozen)
    store.upsert(spark.createDataFrame(rows, CHUNK))
    queries = spark.createDataFrame([(1, "a h b"), (2, "g zz"), (3, "zz"), (4, None)], "query_id bigint, text string")
    scoring = Scoring.IDF_SQUARED if frozen else Scoring.CLASSIC
    ranks = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert ranks(bm25_top_k(store.postings(), queries, "id", 5, scoring)) == ranks(bm25_top_k(store.load(), queries, "id", 5, scoring))
    store.delete_document("d1")
    store.upsert(spark.createDataFrame([chunk("002", "a a a", "d2"), chunk("new", "g g h", "d9")], CHUNK))
    live = ranks(bm25_top_k(store.load(), queries, "id", 5, scoring))
    stored = ranks(bm25_top_k(store.postings(), queries, "id", 5, scoring))
    assert (live == stored) != frozen  # frozen weights are those of their time
    plan = bm25_top_k(store.postings(), queries, "id", 5, scoring)._jdf.queryExecution().optimizedPlan().toString()
    assert "/data" not in plan and "embedding" not in plan
    store.clear()
    assert bm25_top_k(store.postings(), queries, "id", 5, scoring).count() == 0


def test_a_judge_in_the_service(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "one.txt").write_text("# Install\nRun the installer and restart the node.\f# Network\nOpen port 6334 for the gateway.")

    def judge(system, prompt):
        n = prompt.count("Chunk: ")
        return "[" + ", ".join(f'{{"id": {i}, "score": {9 if "gateway" in part else 1}}}' for i, part in enumerate(prompt.split("Chunk: ")[1:])) + "]" if n else ""

    service = RetrievalService(ChunkStore(spark, str(tmp_path / "index")), Config(vector_size=64, max_chunk_tokens=30, chunk_overlap_tokens=5), parser=text_parser, judged_by=lambda: judge)
    service.index(str(folder), "*.txt")
    found = service.search("which port does the gateway need", 3).collect()
    assert [(r["section"], r["relevance_score"], r["new_rank"]) for r in found] == [("Network", 9.0, 1)]


def test_sections_by_the_outline_of_files(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "one.txt").write_text("Cover\n# Install\nRun the installer.\n## Restart\nRestart the node.\f# Network\nOpen port 6334.")
    (tmp_path / "files" / "two.txt").write_text("No headings here, only text.")
    service = RetrievalService(ChunkStore(spark, str(tmp_path / "index")), Config(vector_size=64), parser=text_parser, outline=text_outline, root=str(tmp_path))
    service.index("files", "*.txt")
    got = {(r["source_document"], r["section_path"]): r["text"] for r in service.store.load().collect()}
    assert got[("one.txt", "Install")].startswith("Run the installer") and got[("one.txt", "Install > Restart")] == "Restart the node." and got[("one.txt", "Network")] == "Open port 6334."
    assert [t for (d, _), t in got.items() if d == "two.txt"] == ["No headings here, only text."]
    with pytest.raises(FileNotFoundError):
        service.index("none")


def test_colours_of_parsers():
    assert [color_key_of(c) for c in (0, (0.5,), (1, 0, 0.25), [0, 0, 0, 1], None, ("/P1",), (1, 2))] == ["gray_0.00", "gray_0.50", "1.00_0.00_0.25", "cmyk_0.00_0.00_0.00_1.00", "default", "default", "default"]


def test_pooled_models():
    states = lambda ids, mask: np.stack([ids, ids * 0 + 1], -1).astype(float)
    out = pooled_embedder(lambda t: [len(w) for w in t.split()], states, limit=2)(["aaa a zzzzzzzzz", "", None, "aa"])
    assert np.allclose(out[0], np.array([2, 1]) / 5**0.5) and (out[1:3] == 0).all() and np.allclose(out[3], np.array([2, 1]) / 5**0.5)


def test_payload(spark):
    df = spark.createDataFrame([chunk("a"), chunk("b", None, metadata=None, section=None, section_path=None)], CHUNK)
    back = {r["id"]: r for r in from_payload(to_payload(df)).collect()}
    assert back["a"]["metadata"] == {"Pages": "1,2"} and back["b"]["metadata"] == {} and back["b"]["section_path"] == "" and "embedding" not in back["a"].asDict()


def test_service_from_files_to_answers(spark, tmp_path):
    files = tmp_path / "files"
    files.mkdir()
    (files / "one.txt").write_text("# Install\nRun the installer and restart the node.\nCheck the cluster log.\f# Network\nOpen port 6334 for the gateway. The gateway needs a certificate.")
    (files / "two.txt").write_text("# Backup\nCopy the snapshot of the volume to another zone every night.")
    words = words_of(scan(spark, str(files), "*.txt"), text_parser)
    assert words.where("document = 'one.txt' AND page = 2").count() == 12
    service = RetrievalService(ChunkStore(spark, str(tmp_path / "index")), Config(vector_size=64, max_chunk_tokens=30, chunk_overlap_tokens=5), parser=text_parser)
    n = service.index(str(files), "*.txt")
    assert n == service.store.load().count() >= 3
    assert service.index(str(files), "*.txt") == n and service.store.load().count() == n
    best = service.search("which port does the gateway need", 2).orderBy("new_rank").first()
    assert best["section"] == "Network" and best["source_document"] == "one.txt"
    tools = Tools(service)
    told = tools.search_documents("snapshot of a volume", 1)
    assert told.startswith("Context from documents:\n\n[Source: two.txt, Section: Backup, Pages: 1-1]\n")
    assert tools.index_document(str(files / "none.txt")).startswith("Failed to index document: ")
    assert "Deleted" in tools.delete_document("two.txt") and service.store.load().where("source_document = 'two.txt'").count() == 0
    assert "Cleared" in tools.clear_index() and tools.search_documents("port") == NOTHING


def test_contexts_of_many_queries(spark):
    results = spark.createDataFrame([(1, 2, "d", "p", "s", 1, 1, "second"), (1, 1, "d", None, None, 1, 1, "first")], "query_id bigint, new_rank int, source_document string, section_path string, section string, start_page int, end_page int, text string")
    got = {r["query_id"]: r["context"] for r in contexts(results, spark.createDataFrame([(1,), (2,)], "query_id bigint")).collect()}
    assert got[1] == "Context from documents:\n\n[Source: d, Pages: 1-1]\nfirst\n\n[Source: d, Section: p, Pages: 1-1]\nsecond\n\n" and got[2] == NOTHING


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    store = ChunkStore(spark, str(tmp_path / "index"))
    for part, rows in enumerate([[chunk("a", "one"), chunk("b", "two")], [chunk("a", "three")]]):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(CHUNK).parquet(str(source))
        query = upsert_stream(stream, store, str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
    assert texts(store.load()) == {"a": "three", "b": "two"}


def test_a_missing_pdf_library_is_said(spark):
    try:
        import pdfplumber  # noqa: F401
    except ImportError:
        from chunkwright.sources.pdf import pdf_parser

        with pytest.raises(RuntimeError, match="PDF library"):
            list(pdf_parser(b""))
