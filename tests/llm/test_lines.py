import itertools
import random

from chunkwright.llm.lines import frequent_lines, prefix_span, repeated_lines, without_repeated_lines


def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = [f"own line {'abcdefgh'[i % 8]}{chr(97 + i % 26)}{chr(97 + i // 26)}", " Page %d  of 9 " % i if i % 2 else "PAGE 7 of\t9", "", "shared"] + (["Follow  us", "Share this"] if i % 3 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) + ("\r\n" if i % 5 else ""), "s%d" % (i % 2)))
    rows += [(100, None, "s0"), (101, "", "s0"), (102, "shared", None), (103, "shared\nshared", "s2"), (7, "shared", "s1"), (104, "\n" * 5000, "s0")]
    return spark.createDataFrame([(*r, "x") for r in rows], "chunk_no bigint, text string, source_document string, lines_removed string")


def form(line):
    import re

    return re.sub("[0-9]+", "0", " ".join(line.split()).lower())


def expected(rows, least):
    support, where = {}, []
    for r in rows:
        if r["text"] is None or r["source_document"] is None:
            continue
        for n, line in enumerate(r["text"].split("\n")):
            if form(line):
                support.setdefault((r["source_document"], form(line)), set()).add(r["chunk_no"])
                where.append((r["chunk_no"], n, r["source_document"], form(line)))
    return {(k, n) for k, n, s, f in where if len(support[s, f]) >= least}


def test_occurrences(spark):
    df = frame(spark)
    rows = [r for r in df.collect()]
    got = {(r["chunk_no"], r["line_no"]) for r in repeated_lines(df).collect()}
    assert got == expected(rows, 10) and got
    assert repeated_lines(df.limit(0)).count() == 0
    assert {(r["chunk_no"], r["line_no"]) for r in repeated_lines(df, min_rows=1).collect()} == expected(rows, 1)


def test_sequences_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 5))), "s%d" % (i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "chunk_no bigint, text string, source_document string")
    names = {}
    for r in df.collect():
        for c in "abcd":
            names[r["source_document"], c] = spark.sql(f"SELECT xxhash64('{r['source_document']}', '{c}')").first()[0] if (r["source_document"], c) not in names else names[r["source_document"], c]
    back = {v: k for k, v in names.items()}
    support = {}
    for k, t, s in rows:
        seen = {tuple(t.split("\n")[i] for i in at) for n in range(1, 6) for at in itertools.combinations(range(len(t.split("\n"))), n)} if t else set()
        for p in seen:
            support.setdefault((s, p), set()).add(k)
    frequent = {(s, p): ks for (s, p), ks in support.items() if len(ks) >= 6}
    inside = lambda p, q: len(p) < len(q) and any(tuple(q[i] for i in at) == p for at in itertools.combinations(range(len(q)), len(p)))
    want = {(s, p, k) for (s, p), ks in frequent.items() if not any(s == t and len(ks) == len(other) and inside(p, q) for (t, q), other in frequent.items()) for k in ks}
    spans = prefix_span(frequent_lines(df, min_rows=6), min_rows=6).collect()
    got = {(back[r["pattern"][0]["a"]][0], tuple(back[i["a"]][1] for i in r["pattern"]), r["chunk_no"]) for r in spans}
    assert got == want and len(got) == len(spans)
    text = {k: t.split("\n") for k, t, _ in rows}
    for r in spans:
        assert [text[r["chunk_no"]][i] for i in r["at"]] == [back[i["a"]][1] for i in r["pattern"]]


def test_long_sequences_with_wide_gaps(spark):
    rows = [(i, "\n".join(["Header", *[f"own {chr(97 + i)}{chr(97 + n)}" for n in range(9)], "Legal", "", "notice", "", "Footer", "End"]), "s") for i in range(12)]
    spans = prefix_span(frequent_lines(spark.createDataFrame(rows, "chunk_no bigint, text string, source_document string"))).collect()
    assert {(r["chunk_no"], tuple(r["at"])) for r in spans} == {(i, (0, 10, 12, 14, 15)) for i in range(12)} and {r["rows"] for r in spans} == {12}


def test_a_long_passage_gives_no_subsets(spark):
    passage = [f"notice {chr(97 + i)}" for i in range(9)]
    rows = [(i, "\n".join([f"own {chr(97 + i)}", *passage, *(["tail"] if i % 2 else [])]), "s") for i in range(24)]
    spans = prefix_span(frequent_lines(spark.createDataFrame(rows, "chunk_no bigint, text string, source_document string"))).collect()
    assert {(len(r["pattern"]), r["rows"]) for r in spans} == {(9, 24), (10, 12)}


def test_clean_texts(spark):
    df = frame(spark)
    clean = {(r["chunk_no"], r["source_document"]): r for r in without_repeated_lines(df).collect()}
    gone = expected(df.collect(), 10)
    for r in df.collect():
        c = clean[r["chunk_no"], r["source_document"]]
        if r["text"] is None:
            assert c["text"] is None
        elif r["chunk_no"] != 7:
            assert c["text"] == "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (r["chunk_no"], n) not in gone)
    assert without_repeated_lines(df).columns == df.columns
