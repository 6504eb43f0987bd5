import math
from collections import Counter

import regex

from chunkwright.llm.freq import term_frequencies
from chunkwright.llm.terms import log_entropy

TERM = regex.compile(r"[\p{L}\p{N}]+")
ROWS = [
    (1, "The cat, the CAT and the dog"), (2, "a dog  über_alles ΣΊΣΥΦΟΣ"), (3, None), (4, ""), (5, "--- ..."), (6, "the cat the cat x² ٣ 日本 語"),
    (7, "the " * 3000), (1, "again the first"), (None, "nobody's"), (8, "dog"),
]


def counts():
    tf = {}
    for k, t in ROWS:
        if k is not None and t:
            tf.setdefault(k, Counter()).update(TERM.findall(t.lower()))
    return {k: c for k, c in tf.items() if c}


def frame(spark):
    return spark.createDataFrame([(k, t, 9) for k, t in ROWS], "chunk_no bigint, text string, term int")


def test_log_entropy(spark):
    tf = counts()
    df, gf = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        gf.update(c)
    n = len(tf)
    want = {}
    for k, c in tf.items():
        for t, x in c.items():
            entropy = -sum(d[t] / gf[t] * math.log(d[t] / gf[t]) for d in tf.values() if d[t])
            want[k, t] = (x, df[t], gf[t], math.log(1 + x) * (1 - entropy / math.log(n)))
    got = {(r["chunk_no"], r["term"]): (r["tf"], r["df"], r["gf"], r["score"]) for r in log_entropy(frame(spark)).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:3] == want[k][:3] and abs(got[k][3] - want[k][3]) < 1e-9
    assert log_entropy(frame(spark).limit(0)).count() == 0
    one = log_entropy(spark.createDataFrame([(1, "b b")], "chunk_no bigint, text string")).collect()
    assert abs(one[0]["score"] - math.log(3)) < 1e-12


def test_frequencies(spark):
    tf = counts()
    occurrences, rows = Counter(), Counter()
    for c in tf.values():
        occurrences.update(c)
        rows.update(c.keys())
    got = {r["term"]: r for r in term_frequencies(frame(spark)).collect()}
    assert {t: (r["occurrences"], r["rows"]) for t, r in got.items()} == {t: (occurrences[t], rows[t]) for t in occurrences}
    for t, r in got.items():
        assert r["mark"] == ("rare" if rows[t] <= 2 else "common" if rows[t] * 1000 > 600 * len(tf) else "useful")
    assert term_frequencies(frame(spark).limit(0)).count() == 0


def test_a_hot_term_over_many_partitions(spark):
    df = spark.range(20_000).selectExpr("id AS chunk_no", "concat('hot hot w', id % 7) AS text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["term"]: (r["occurrences"], r["rows"]) for r in term_frequencies(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["hot"] == (40_000, 20_000) and sum(n for t, (n, _) in got.items() if t != "hot") == 20_000
