import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.llm.split import split_chunks, split_oversized, split_text


def size(text):
    return len(text.encode())


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(text[b:z] for _, b, z in pieces) == text
    assert all(size(text[a:z]) <= limit for a, _, z in pieces)
    assert (len(pieces) > 1) == (size(text) > limit)
    for (_, _, end), (start, added, _) in zip(pieces, pieces[1:]):
        assert added == end
        assert overlap <= size(text[start:added]) <= overlap + 3
    for (_, b0, z0), (_, b1, z1) in zip(pieces, pieces[1:]):  # no two neighbours would have fit
        room = limit if b0 == 0 else limit - overlap - 3
        assert size(text[b0:z1]) > room
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n\réジ́🎉", max_size=600), st.integers(40, 90), st.integers(0, 20))
def test_pieces_are_whole_and_within_limits(text, limit, overlap):
    check(text, limit, overlap)


def test_strong_boundaries_are_kept():
    text = ("One sentence here. Another one there. " * 3 + "\n\n") * 8
    for _, _, end in check(text, 300, 30)[:-1]:
        assert text[:end].endswith("\n\n")
    text = "word " * 300
    assert all(text[:end].endswith(" ") for _, _, end in check(text, 300, 30)[:-1])


def test_unbroken_and_very_long_texts():
    check("x" * 50_000, 1600, 200)
    check("é" * 5000 + " tail", 1600, 200)
    check("a" + "́" * 4000, 1600, 200)
    check("lorem ipsum dolor. " * 40_000, 1600, 200)
    with pytest.raises(ValueError):
        split_text("x", 100, 95)


def test_rows(spark):
    rows = [(1, "s" * 5000, "p", "kept"), (2, "short", "p", None), (3, None, None, "n"), (4, "", "p", "e"), (1, "s" * 5000, "p", "kept")]
    df = spark.createDataFrame(rows, "chunk_no bigint, text string, section_path string, piece_index string")
    out = split_oversized(df)
    assert out.columns == ["chunk_no", "text", "section_path", "piece_index", "piece_total", "piece_start", "added_start"]
    by = {k: [r for r in out.collect() if r["chunk_no"] == k] for k in range(1, 5)}
    assert len(by[1]) == 8 and {r["piece_total"] for r in by[1]} == {4} and {r["section_path"] for r in by[1]} == {"p"}
    assert [(r["text"], r["piece_index"], r["piece_total"]) for k in (2, 3, 4) for r in by[k]] == [("short", 0, 1), (None, 0, 1), ("", 0, 1)]
    assert split_oversized(df.limit(0)).count() == 0


def test_indices_are_counted_anew(spark):
    rows = [(1, "a" * 4000, "d", "p", 0), (2, "b", "d", "p", 1), (3, "c" * 2000, "d", "p", 1), (4, "d", "d", None, 0), (5, "e", None, None, None), (6, "f", "d", None, 5)]
    df = spark.createDataFrame(rows, "chunk_no bigint, text string, source_document string, section_path string, chunk_index int")
    out = split_chunks(df).orderBy("source_document", "section_path", "chunk_index").collect()
    numbers = {}
    for r in out:
        numbers.setdefault((r["source_document"], r["section_path"]), []).append((r["chunk_index"], r["chunk_total"], r["chunk_no"]))
    assert numbers["d", "p"] == [(0, 6, 1), (1, 6, 1), (2, 6, 1), (3, 6, 2), (4, 6, 3), (5, 6, 3)]
    assert numbers["d", None] == [(0, 2, 4), (1, 2, 6)] and numbers[None, None] == [(0, 1, 5)]
    assert split_chunks(df.limit(0)).count() == 0
