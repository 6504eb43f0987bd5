"""Registered queries against their SQL on the smallest tables, where these exist; how the entry module does without the optional subpackage."""

import importlib
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


def alike(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.catalog.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    rows = [tuple(alike(r[c]) for c in columns) for r in df.collect()]
    sql = entry.catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    with duckdb.connect() as db:
        for p in FOLDER.glob("*.parquet"):
            db.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
        result = db.sql(sql)
        assert sorted(result.columns) == columns
        at = [result.columns.index(c) for c in columns]
        want = [tuple(alike(r[i]) for i in at) for r in result.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=order) == sorted(want, key=order)


@needs_data
def test_whole_sections_have_every_document_and_word(spark):
    got = {r["document"]: r for r in entry.catalog.queries()["simple_sections_whole"](spark, str(FOLDER)).collect()}
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(str(FOLDER / "documents.parquet")).where(r"text RLIKE '\\S'").collect()}
    assert got.keys() == texts.keys() and len(got) > 50
    assert all(got[k]["text"].split() == t.split() for k, t in texts.items())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "chunkwright.llm", None)
    monkeypatch.setitem(sys.modules, "chunkwright.llm.queries", None)
    alone = importlib.reload(entry)
    try:
        assert alone.queries().keys() == alone.catalog.queries().keys()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_nothing_else_imports_the_optional_subpackage():
    root = Path(entry.__file__).parent / "chunkwright"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "chunkwright.llm" not in p.read_text(), p
