import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkwright.operators import chunking, layout, outline, stopwords
from chunkwright.operators.embed import embed_chunks, embed_queries, hashing_embedder, mean_pooled


# ---- chunks ----


def words_tokenizer(text):
    import re

    return [m.end() for m in re.finditer(r"\s*\S+|\s+$", text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.text(alphabet="ab .!\n", max_size=80)), max_size=4), st.integers(1, 12), st.data())
def test_chunks_hold_every_word_and_keep_the_limit(pages, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    pages = sorted(pages)
    made = chunking.chunk_section(pages, limit, overlap, words_tokenizer)
    whole = " ".join(t for _, t in pages)
    if not whole.strip():
        assert made == []
        return
    assert all(len(words_tokenizer(t)) <= limit + 1 for t, _ in made)
    at = 0
    for text, on in made:  # the chunks' words, less what repeats, are the section's words in order
        assert on == sorted(set(on)) or len(made) == 1
    if overlap == 0:
        assert "".join("".join(t for t, _ in made).split()) == "".join(whole.split())
    assert at == 0 and set("".join(whole.split())) == set("".join("".join(t.split()) for t, _ in made))


def test_prefix_and_overlap():
    text = "One two three. Four five six. Seven eight"
    assert chunking.prefix_within(text, 7, words_tokenizer) == "One two three. Four five six."
    assert chunking.prefix_within(text, 2, words_tokenizer) == "One two"
    assert chunking.prefix_within("abc", 0, words_tokenizer) == "a"
    assert chunking.overlap_of(text, 4, words_tokenizer) == "Seven eight"
    assert chunking.overlap_of(text, 8, words_tokenizer) == "" and chunking.overlap_of(text, 0, words_tokenizer) == ""
    assert chunking.overlap_of("a b c d", 2, words_tokenizer) == " c d"


def test_byte_and_piece_tokenizers():
    assert chunking.byte_tokenizer("aé") == [1, 2, 2]
    assert chunking.piece_tokenizer("ab 12345, c") == [2, 6, 8, 9, 11]
    assert "".join("x 1234 ,ñ  "[a:b] for a, b in zip([0, *chunking.piece_tokenizer("x 1234 ,ñ  ")], chunking.piece_tokenizer("x 1234 ,ñ  "))) == "x 1234 ,ñ  "


def test_a_public_vocabulary_counts_tokens():
    public = pytest.importorskip("public_tokenizers")
    bpe = chunking.BpeTokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    ends = bpe("Hello world, naïve 日本")
    assert ends == sorted(ends) and ends[-1] == len("Hello world, naïve 日本") and 5 <= len(ends) <= 14


def test_chunk_sections(spark):
    rows = [
        ("d", 0, "H", "A > H", 2, 3, 4, [(3, "one. two three four. five"), (4, "six seven")]), ("d", 1, "", "", 1, 1, 1, [(1, "short")]),
        ("d", 2, None, None, 1, 1, 1, [(1, "   ")]), ("d", 3, "x", "x", 1, 1, 1, None), ("d", 4, "x", "x", 1, 1, 1, []), (None, 5, "x", "x", 1, 2, 2, [(None, None), (2, "t")]),
    ]
    df = spark.createDataFrame(rows, "document string, section_ord int, heading string, heading_path string, level int, start_page int, end_page int, page_texts array<struct<page_number:int,text:string>>")
    out = chunking.chunk_sections(df, 5, 1).orderBy("section_ord", "chunk_index").collect()
    first = [r for r in out if r["section_ord"] == 0]
    assert [r["chunk_index"] for r in first] == list(range(len(first))) and {r["chunk_total"] for r in first} == {len(first)} and len(first) > 1
    assert first[0]["start_page"] == 3 and first[-1]["end_page"] == 4 and first[0]["section_path"] == "A > H" and first[0]["metadata"]["BookmarkLevel"] == "2"
    assert [r["text"] for r in out if r["section_ord"] == 1] == ["short"] and out[-1]["text"].strip() == "t"
    assert [r["id"] for r in out if r["section_ord"] == 1] == ["d_bookmark_nosection_chunk_0"]
    assert {r["section_ord"] for r in out} == {0, 1, 5}
    assert chunking.chunk_sections(df.limit(0), 5, 1).count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_sections(df, 5, 5)


# ---- layout ----


def section_spec(words, depth):
    """Sections of one document by going through its words once."""
    rounded = [round(w["font_size"], 1) for w in words]
    body = max(dict.fromkeys(rounded), key=rounded.count)
    sizes = sorted({r for w, r in zip(words, rounded) if w["font_size"] > body * 1.1}, reverse=True)

    def level(w):
        r = round(w["font_size"], 1)
        return sizes.index(r) + 1 if r in sizes else len(sizes) + 1 if w["is_bold"] and w["font_size"] >= body else 0

    out, current, names, before = [], None, {}, None
    for w in words:
        n = level(w)
        if 1 <= n <= depth:
            if before and before["head"] and abs(before["w"]["font_size"] - w["font_size"]) < 0.5 and before["w"]["page"] == w["page"]:
                current["title"].append(w["text"])
            else:
                current = {"title": [w["text"]], "level": n, "start": w["page"], "pages": {}, "path": None}
                out.append(current)
            before = {"w": w, "head": True}
            continue
        if current is None:
            current = {"title": [], "level": 1, "start": 1, "pages": {}, "path": ""}
            out.append(current)
        if current["path"] is None:
            names = {k: v for k, v in names.items() if k < current["level"]} | {current["level"]: " ".join(current["title"])}
            current["path"] = " > ".join(names[k] for k in sorted(names))
        current["pages"].setdefault(w["page"], []).append(w["text"])
        before = {"w": w, "head": False}
    return [(" ".join(s["title"]), s["path"], s["level"], s["start"], max(s["pages"]), [(p, " ".join(t)) for p, t in sorted(s["pages"].items())]) for s in out if s["pages"]]


def test_sections_by_format_against_one_pass(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for d in range(60):
        page, words = 1, []
        for i in range(rng.randint(1, 40)):
            page += rng.random() < 0.08
            size, bold = rng.choice([(10.0, False)] * 6 + [(18.0, False), (14.0, False), (10.0, True), (10.04, False)])
            words.append({"ord": i, "page": page, "text": f"w{i}", "font_size": size, "is_bold": bold})
        want[f"d{d}"] = section_spec(words, 2 + d % 2)
        rows += [(f"d{d}", w["ord"], w["page"], w["text"], "F", w["font_size"], "default", w["is_bold"], False, 100.0, 90.0) for w in words]
    df = spark.createDataFrame(rows, "document string, ord bigint, page int, text string, font_name string, font_size double, color_key string, is_bold boolean, is_italic boolean, top double, bottom double")
    for depth in (2, 3):
        got = {}
        for r in layout.format_sections(df, depth).orderBy("document", "section_ord").collect():
            got.setdefault(r["document"], []).append((r["heading"], r["heading_path"], r["level"], r["start_page"], r["end_page"], [(p["page_number"], p["text"]) for p in r["page_texts"]]))
        for d, sections in want.items():
            if 2 + int(d[1:]) % 2 == depth:
                assert got.get(d, []) == sections, d
    assert layout.format_sections(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        layout.format_sections(df, 0)


def test_fonts(spark):
    rows = [("d", i, 1, "w", s, c) for i, (s, c) in enumerate([(12.0, "x"), (9.96, "x"), (12.04, "x"), (10.0, "x"), (20.0, "red"), (16.25, "x")])]
    df = spark.createDataFrame([(*r, i > 100) for i, r in enumerate(rows)], "document string, ord bigint, page int, text string, font_size double, color_key string, is_bold boolean")
    assert layout.body_font_size(df).first()["body_size"] == 12.0  # as frequent as 10, and met first
    assert layout.heading_sizes(df).first()["sizes"] == [20.0, 16.2]
    assert layout.heading_sizes(df, color="red").first()["sizes"] == [20.0]
    assert layout.heading_sizes(df, max_size=17.0).first()["sizes"] == [16.2]
    levels = {r["ord"]: r["heading_level"] for r in layout.heading_levels(df, color="red").collect()}
    assert levels == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


def test_line_breaks(spark):
    boxes = [("One", 100, 90), ("line.", 100, 90), ("Next", 96, 86), ("after", 84, 74), ("1.", 60, 50), ("item", 48, 38)]
    df = spark.createDataFrame([("d", i, 1, t, float(a), float(b)) for i, (t, a, b) in enumerate(boxes)], "document string, ord bigint, page int, text string, top double, bottom double")
    got = [r["separator"] for r in layout.line_breaks(df).orderBy("ord").collect()]
    assert got == [None, " ", " ", " ", " ", " "] or got[1] == " "
    spaced = spark.createDataFrame([("d", 0, 1, "a", 100.0, 90.0), ("d", 1, 1, "b", 70.0, 60.0), ("d", 2, 1, "c.", 55.0, 45.0), ("d", 3, 1, "d", 40.0, 30.0)], df.schema)
    assert [r["separator"] for r in layout.line_breaks(spaced).orderBy("ord").collect()] == [None, "\n", " ", "\n"]
    assert layout.page_texts(spaced).first()["text_lines"] == "a\nb c.\nd"


def test_simple_sections(spark):
    df = spark.createDataFrame([("d", i, p, t, 100.0, 90.0) for i, (p, t) in enumerate([(1, "skip"), (2, "a"), (2, "b"), (3, "c")])], "document string, ord bigint, page int, text string, top double, bottom double")
    row = layout.simple_sections(df, 1).first()
    assert (row["start_page"], row["end_page"], [tuple(p) for p in row["page_texts"]]) == (2, 3, [(2, "a b"), (3, "c")])


# ---- outline ----


@pytest.mark.parametrize(
    ("page", "title", "want"),
    [("Intro The  Big\nTitle here", "the big title", 6), ("x Title y", "title", 2), ("nothing", "title", -1), ("", "t", -1), ("t", "", -1), ("big far far far far away Title big title", "big title", 31), ("ends with big", "big title", 10), ("one two", "one  three", -1)],
)
def test_titles_are_found(page, title, want):
    assert outline.find_title(page, title) == want


def test_ends_and_places():
    assert outline.title_end("The  Big  rest", "the big", 0) == 10
    assert outline.title_end("Title: rest", "title", 0) == 5
    assert outline.same_place("a b c", "a\nb\n\nc", 4) == 3 and outline.same_place("a b", "a b", 0) == 0 and outline.same_place("abc", "ab", 3) == 2


def test_sections_by_outline(spark):
    bookmarks = spark.createDataFrame(
        [("d", 0, " Intro ", 1, 1, []), ("d", 1, "Setup", 1, None, []), ("d", 2, "Deep", 2, 3, ["Setup"]), ("d", 3, "Gone", 1, 9, []), ("d", 0, " Intro ", 1, 1, [])],
        "document string, ord bigint, title string, level int, page int, parent_titles array<string>",
    )
    flat = [(r["title"], r["full_title"], r["page"]) for r in outline.flattened(bookmarks, 2).orderBy("ord").collect()]
    assert flat == [("Intro", "Intro", 1), ("Setup", "Setup", 1), ("Deep", "Setup > Deep", 3), ("Gone", "Gone", 9)]
    assert [r["title"] for r in outline.flattened(bookmarks, 2, 1).collect()] == ["Gone"]  # Deep lies below a skipped one
    pages = spark.createDataFrame([("d", 1, "Intro text one", "Intro\ntext one"), ("d", 2, "more Setup run it", "more\nSetup\nrun it"), ("d", 3, "still Deep below", "still Deep\nbelow")], "document string, page int, text_spaced string, text_lines string")
    marks = outline.flattened(bookmarks.where("page IS NULL OR page < 9"), 2)
    assert [(r["title"], r["start_page"], r["start"]) for r in outline.located(marks, pages).orderBy("ord").collect()] == [("Intro", 1, 0), ("Setup", 2, 5), ("Deep", 3, 6)]
    got = [(r["heading"], r["start_page"], r["end_page"], [tuple(p) for p in r["page_texts"]]) for r in outline.outline_sections(bookmarks.where("page IS NULL OR page < 9"), pages, 2).orderBy("section_ord").collect()]
    assert got == [("Intro", 1, 2, [(1, "text one"), (2, "more")]), ("Setup", 2, 3, [(2, "run it"), (3, "still")]), ("Deep", 3, 3, [(3, "below")])]
    assert outline.outline_sections(bookmarks.limit(0), pages).count() == 0


# ---- embeddings ----


def test_embeddings(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"word{i % 2}", "d", "p", "s") for i in range(130)], "chunk_no bigint, text string, source_document string, section_path string, section string")
    seen = embed_chunks(df, lambda: hashing_embedder(32), batch=50).orderBy("chunk_no").collect()
    want = hashing_embedder(32)(["Document: d\nSection: p\n\nword0", "Document: d\nSection: p\n\nword1"])
    assert all(r["embedding"] == want[r["chunk_no"] % 2].tolist() for r in seen if r["chunk_no"] != 3)
    assert embed_queries(df.select("chunk_no", "text").limit(1), lambda: hashing_embedder(32)).first()["vec"] == hashing_embedder(32)(["word0"])[0].tolist()
    assert not hashing_embedder(8)([""])[0].any()


def test_mean_pooling():
    import numpy as np

    states = np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(mean_pooled(states, np.array([[1, 1, 0]])), [[0.6, 0.8]])


# ---- stop words ----


@pytest.mark.parametrize(("language", "some"), [("en", "the and is of to"), ("de", "der die das und ist"), ("fr", "le la et est de"), ("es", "el la de y en"), ("en-extended", "the actually already important example")])
def test_lists_have_the_usual_words(spark, language, some):
    assert set(some.split()) <= set(stopwords.words(language))


def test_list_algebra(spark, tmp_path):
    en = stopwords.words("en")
    assert stopwords.words(None) == [] and len(stopwords.words("en-extended")) > len(en) and set(en) <= set(stopwords.words("en-extended"))
    with pytest.raises(ValueError):
        stopwords.words("xx")
    assert stopwords.combined(["word1", "word2"], ["word3", "word4"]) == ["word1", "word2", "word3", "word4"]
    assert stopwords.combined(["word1", "duplicate"], ["duplicate", "word2"]) == ["word1", "duplicate", "word2"]
    assert len(stopwords.combined(en[:5], stopwords.words("de")[:5], stopwords.words("fr")[:5])) >= 15
    assert stopwords.extended(["word1", "word2"], "word2", "word3") == ["word1", "word2", "word3"]
    assert {"the", "custom1", "custom2"} <= set(stopwords.extended(en, "custom1", "custom2"))
    assert stopwords.excluded(["Word1", "WORD2", "word3"], "word1", "word2") == ["word3"]
    assert len(stopwords.excluded(en, "the", "and", "is")) == len(en) - 3
    assert stopwords.from_file(spark, str(tmp_path / "none.txt")) == []
    (tmp_path / "w.txt").write_text("word1\n\n# note\n  word2  \nword3\n   \n")
    assert stopwords.from_file(spark, str(tmp_path / "w.txt")) == ["word1", "word2", "word3"]
    rows = spark.createDataFrame([("en", "the"), ("en", "cat"), ("de", "the"), (None, "the")], "lang string, term string")
    assert {tuple(r) for r in stopwords.without_stop_words(rows).collect()} == {("en", "cat"), ("de", "the"), (None, "the")}
