import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwright.operators import bm25, dense
from chunkwright.operators.chunking import piece_tokenizer
from chunkwright.operators.components import connected_components
from chunkwright.operators.dense import dense_top_k
from chunkwright.operators.expand import chunks_at, expand
from chunkwright.operators.fusion import branch_budgets, fuse
from chunkwright.operators.positions import with_offsets
from chunkwright.operators.rerank import fallback, judge, judge_answers, judge_prompt, judged_scores, model_score, ranked, rerank_above, truncated
from chunkwright.operators.skew import grouped_with_totals, with_key_totals
from chunkwright.plans import catalog
from chunkwright.schema import Config, Scoring


def test_dense_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((500, 8)), rng.standard_normal((7, 8))
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [1.0]), (603, [math.nan] * 8)]
    chunks = spark.createDataFrame(rows, "chunk_no bigint, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(90, None), (91, [0.0] * 8)], "query_id bigint, vec array<double>")
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 6)
    got = dense_top_k(chunks, queries, "chunk_no", 5, dimensions=8).orderBy("query_id", "rank").collect()
    want = [(i, j) for i in range(7) for j in sorted(range(500), key=lambda j: (-s[i, j], j))[:5]]
    assert [(r["query_id"], r["chunk_no"]) for r in got] == want
    assert dense_top_k(chunks.limit(0), queries, "chunk_no", 5, dimensions=8).count() == 0
    assert dense_top_k(chunks, queries.limit(0), "chunk_no", 5, dimensions=8).count() == 0


def bm25_by_hand(docs, query, scoring):
    terms = {k: t.lower().split() for k, t in docs.items() if t and t.split()}
    n, average = len(terms), sum(map(len, terms.values())) / len(terms)
    df = Counter(w for t in terms.values() for w in set(t))
    idf = {w: math.log((n - d + 0.5) / (d + 0.5) + 1) for w, d in df.items()}
    avg = 400.0 if scoring is Scoring.LIVE_IDF else average
    sat = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    q = Counter(query.lower().split())
    weight = {w: idf.get(w, 0) * (1 if scoring is Scoring.CLASSIC else sat(c, sum(q.values()))) * (idf.get(w, 0) if scoring is Scoring.IDF_SQUARED else 1) for w, c in q.items()}
    out = {k: sum(weight[w] * sat(t.count(w), len(t)) for w in q if w in t) for k, t in terms.items() if set(t) & set(q)}
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("scoring", list(Scoring))
def test_bm25_against_the_formula(spark, scoring):
    rng = random.Random(2)
    docs = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for i in range(60)} | {100: None, 101: "", 102: "..."}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_no bigint, text string")
    asked = {1: "a b b zz", 2: "h", 3: "zz", 4: None, 5: ""}
    queries = spark.createDataFrame(list(asked.items()), "query_id bigint, text string")
    got = {}
    for r in bm25.bm25_scores(chunks, queries, "chunk_no", scoring).collect():
        got.setdefault(r["query_id"], {})[r["chunk_no"]] = round(r["score"], 6)
    assert set(got) == {1, 2}
    del docs[102]
    for i in got:
        want = bm25_by_hand(docs, asked[i], scoring)
        assert got[i].keys() == want.keys() and all(abs(got[i][k] - want[k]) < 2e-6 for k in want)
    assert bm25.bm25_scores(chunks.limit(0), queries, "chunk_no", scoring).count() == 0
    best = bm25.bm25_top_k(chunks.repartition(3), queries, "chunk_no", 4, scoring).orderBy("query_id", "rank").collect()
    want = [(i, k) for i in sorted(got) for k in sorted(got[i], key=lambda k: (-got[i][k], k))[:4]]
    assert [(r["query_id"], r["chunk_no"]) for r in best] == want
    assert bm25.bm25_top_k(chunks.limit(0), queries, "chunk_no", 4, scoring).count() == 0
    assert bm25.bm25_top_k(chunks, queries.limit(0), "chunk_no", 4, scoring).count() == 0


@pytest.mark.parametrize("scoring", list(Scoring))
def test_bm25_totals_are_those_of_all_scores(spark, monkeypatch, scoring):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(700)]
    docs += [(3, "a Zz"), (3, "b"), (900, "..."), (901, None), (None, "a b"), (902, "ΟΔΟΣ"), (902, "z")]
    chunks = spark.createDataFrame(docs, "chunk_no bigint, text string").repartition(5)
    asked = [(i, " ".join(rng.choice("abcdefghz") for _ in range(rng.randint(1, 4)))) for i in range(40)]
    queries = spark.createDataFrame([*asked, (50, "none"), (51, ""), (52, None), (53, "zz none"), (54, "οδος")], "query_id bigint, text string")
    scores = bm25.bm25_scores(chunks, queries, "chunk_no", scoring).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.sum("score").alias("total"))
    want = {r["query_id"]: r for r in scores.collect()}
    assert len(want) == 42
    for terms, postings, wide, block in ((10**6, 10**6, 4096, 4096), (30, 100, 64, 7)):
        for name, value in (("TOTALS_TERMS", terms), ("TOTALS_POSTINGS", postings), ("TOTALS_CHUNKS", wide), ("QUERY_BLOCK", block)):
            monkeypatch.setattr(bm25, name, value)
        got = {r["query_id"]: r for r in bm25.bm25_totals(chunks, queries, "chunk_no", scoring).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert r["n"] == want[i]["n"] and math.isclose(r["best"], want[i]["best"], rel_tol=1e-12) and math.isclose(r["total"], want[i]["total"], rel_tol=1e-12)
    assert bm25.bm25_totals(chunks.limit(0), queries, "chunk_no", scoring).count() == 0
    assert bm25.bm25_totals(chunks, queries.limit(0), "chunk_no", scoring).count() == 0


@pytest.fixture
def no_broadcasts(spark):
    """Joins as with larger tables, which Spark doesn't broadcast by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, -1)
    yield
    spark.conf.unset(name)


def test_bm25_scores_moves_no_row_for_each_score(spark, tmp_path, no_broadcasts):
    spark.createDataFrame([(i, f"common word{i % 7}") for i in range(600)], "chunk_no bigint, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(i, f"Common word{i % 7}") for i in range(100)], "query_id bigint, text string").write.parquet(f"{tmp_path}/queries.parquet")
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm

    def moved():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x := stages.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(stages.size())}

    before = moved()
    rows = catalog.queries()["bm25_scores"](spark, str(tmp_path)).collect()
    assert len(rows) == 100 and all(r["n_chunks"] == 600 for r in rows)
    assert sum(n for i, n in moved().items() if i not in before) < 10_000  # of 60,000 scores


def test_searches_in_passes(spark, monkeypatch):
    docs = [(i, " ".join("abcdefgh"[j] for j in range(8) if i >> j & 1)) for i in range(200)]
    chunks = spark.createDataFrame(docs, "chunk_no bigint, text string")
    queries = spark.createDataFrame([(i, "abcdefgh"[i % 8] + " " + "abcdefgh"[(i + 3) % 8]) for i in range(9)], "query_id bigint, text string")
    once = sorted(map(tuple, bm25.bm25_top_k(chunks, queries, "chunk_no", 5).collect()))
    monkeypatch.setattr(bm25, "QUERY_TERMS", 4)
    assert sorted(map(tuple, bm25.bm25_top_k(chunks, queries, "chunk_no", 5).collect())) == once and len(once) == 45
    vectors = spark.createDataFrame([(i, [float(i % 7 + 1), 1.0, float(i % 3)]) for i in range(50)], "chunk_no bigint, embedding array<float>")
    asked = vectors.limit(9).select(F.col("chunk_no").alias("query_id"), F.col("embedding").alias("vec"))
    once = sorted(map(tuple, dense.dense_top_k(vectors, asked, "chunk_no", 3, dimensions=3).collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, dense.dense_top_k(vectors, asked, "chunk_no", 3, dimensions=3).collect())) == once and len(once) == 27


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, None), (3, ""), (4, "b"), (4, "c"), (None, "z")], "k bigint, text string")
    stats = bm25.corpus_stats(df, "k").first()
    assert (stats["total_docs"], stats["total_len"], stats["average_len"]) == (2, 5, 2.5)
    assert bm25.corpus_stats(df.limit(0), "k").first()["average_len"] == 1.0
    one = bm25.term_stats(bm25.term_frequencies(df, "k"))
    assert {r["term"]: r["df"] for r in bm25.merged_stats(one, one).collect()} == {"a": 2, "b": 4, "c": 2}


@pytest.mark.parametrize(("k", "weight", "want"), [(10, 0.7, (28, 12)), (5, 0.7, (14, 6)), (5, 0.6, (12, 7)), (10, 0.6, (24, 15)), (5, 1.0, (20, 5))])
def test_budgets(k, weight, want):
    assert branch_budgets(k, weight) == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "query_id bigint, c bigint, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 5, 2)], "query_id bigint, c bigint, rank int")
    got = [(r["c"], r["rank"]) for r in fuse(a, b, by="query_id", key="c", k=3).orderBy("rank").collect()]
    assert got == [(9, 1), (7, 2), (5, 3)]  # 5 and 8 tie; the smaller key comes first


def chunk_table(spark):
    rows = [(f"{d}{p}{i}", d, p, i, 4) for d in "xy" for p in ("p", "q") for i in range(4)] + [("null", "x", None, 0, 2)]
    return spark.createDataFrame(rows, "id string, source_document string, section_path string, chunk_index int, chunk_total int")


def test_expansion(spark):
    chunks = chunk_table(spark)
    hits = chunks.where("id IN ('xp0', 'xp2', 'yq3', 'null')").withColumn("query_id", F.lit(1)).withColumn("rank", F.expr("CASE id WHEN 'yq3' THEN 1 WHEN 'xp2' THEN 2 WHEN 'xp0' THEN 3 ELSE 4 END"))
    order = lambda df: [r["id"] for r in df.orderBy("ord").collect()]
    assert order(expand(hits, chunks, 1)) == ["yq3", "xp2", "xp0", "null", "yq2", "xp1", "xp3"]
    assert order(expand(hits, chunks, 0)) == ["yq3", "xp2", "xp0", "null"]
    assert order(expand(hits, chunks, 9)) == ["yq3", "xp2", "xp0", "null", "yq0", "yq1", "yq2", "xp1", "xp3"]
    assert expand(hits.limit(0), chunks, 1).count() == 0
    assert {r["id"] for r in chunks_at(chunks, "x", [0, 3]).collect()} == {"xp0", "xp3", "xq0", "xq3", "null"}
    assert {r["id"] for r in chunks_at(chunks, "x", [0, 3], "q").collect()} == {"xq0", "xq3"}
    assert chunks_at(chunks, "x", []).count() == 0


def test_ranks_thresholds_and_fallback(spark):
    rows = [(1, "a", 5.0, 1), (1, "b", 9.0, 2), (1, "c", 9.0, 3), (1, "d", None, 4), (1, "e", math.nan, 5), (1, "f", 4.9, 6)]
    df = spark.createDataFrame(rows, "query_id bigint, id string, relevance_score double, original_rank int")
    assert [r["id"] for r in ranked(df).orderBy("new_rank").collect()] == ["b", "c", "a", "f", "d", "e"]
    above = {r["id"]: r["new_rank"] for r in rerank_above(df, 2).collect()}
    assert above == {"b": 1, "c": 2}
    assert {r["id"] for r in rerank_above(df, 9).collect()} == {"a", "b", "c"}  # neither null nor NaN
    low = fallback(df.drop("relevance_score"), 3).orderBy("new_rank").collect()
    assert [(r["id"], r["relevance_score"]) for r in low] == [("a", 5.0), ("b", 4.9), ("c", 4.8)]


def test_judges(spark):
    answers = [(1, '[{"id": 0, "score": 7}, {"id": 1, "score": 2.5}]'), (2, '```json\n[{"id": 1, "score": 3}, {"id": 0, "score": 8}]\n```'), (3, "[]"), (4, "no json"), (5, None), (6, '[{"id": 0, "score": null}, {"id": 1, "score": 1}]')]
    df = spark.createDataFrame(answers, "query_id bigint, content string")
    got = {r["query_id"]: r["s"] for r in df.select("query_id", judged_scores(F.col("content"), F.lit(2)).alias("s")).collect()}
    assert got == {1: [7.0, 2.5], 2: [3.0, 8.0], 3: [5.0, 5.0], 4: [5.0, 5.0], 5: [5.0, 5.0], 6: [5.0, 5.0]}
    by_id = df.where("query_id = 2").select(judged_scores(F.col("content"), F.lit(2), by_id=True).alias("s")).first()["s"]
    assert by_id == [8.0, 3.0]
    candidates = spark.createDataFrame([(q, f"{q}{i}", f"text {i}", i + 1) for q in (1, 2, 5) for i in range(2)], "query_id bigint, id string, text string, original_rank int")
    out = {(r["query_id"], r["new_rank"]): (r["id"], r["relevance_score"]) for r in judge(candidates, 2, df.where("content IS NOT NULL")).collect()}
    assert out == {(1, 1): ("10", 7.0), (2, 1): ("21", 8.0), (5, 1): ("50", 5.0), (5, 2): ("51", 4.9)}
    prompt = judge_prompt(candidates.withColumn("query", F.lit("why?"))).where("query_id = 1").first()
    assert prompt["n"] == 2 and prompt["prompt"].startswith("Query: why?\n\n") and "\n\nChunk: 0\ntext 0\n\nChunk: 1\ntext 1\n\n" in prompt["prompt"]

    def model(system, asked):
        if "why" in asked:
            raise OSError("no answer")
        return '[{"id": 0, "score": 1}, {"id": 1, "score": 9}]'

    prompts = judge_prompt(candidates.withColumn("query", F.when(F.col("query_id") == 5, "why?").otherwise("how?")))
    answered = judge(candidates, 2, judge_answers(prompts, lambda: model)).collect()
    assert {(r["query_id"], r["id"], r["new_rank"]) for r in answered} == {(1, "11", 1), (2, "21", 1), (5, "50", 1), (5, "51", 2)}


def test_a_model_scores_in_batches(spark):
    df = spark.createDataFrame([("q", "qq"), ("q", "x")], "q string, t string")
    got = df.select("t", model_score(F.col("q"), F.col("t"), lambda: lambda qs, ts: [100.0 * (q in t) for q, t in zip(qs, ts)]).alias("s")).collect()
    assert {r["t"]: round(r["s"], 6) for r in got} == {"qq": 10.0, "x": 5.0}


def test_models_get_truncated_texts(spark):
    assert truncated("one two three", 2, piece_tokenizer) == "one two" and truncated("one", 2, piece_tokenizer) == "one"
    df = spark.createDataFrame([("q", "a b c d"), ("q", None)], "q string, t string")
    got = df.select("t", model_score(F.col("q"), F.col("t"), lambda: lambda qs, ts: [100.0 * (len(t) > 3) for t in ts], limit=2).alias("s")).collect()
    assert {r["t"]: round(r["s"], 6) for r in got} == {"a b c d": 5.0, None: 5.0}


def test_configuration():
    with pytest.raises(ValueError):
        Config(max_chunk_tokens=0)
    with pytest.raises(ValueError):
        Config(chunk_overlap_tokens=400)
    assert abs(Config().sparse_weight - 0.3) < 1e-12


def test_offsets_in_large_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.randint(0, 9)) for i in range(3000)]
    rng.shuffle(rows)
    got = with_offsets(spark.createDataFrame(rows, "g string, k bigint, v int"), ["g"], ["k"], F.col("v")).collect()
    at, totals = {}, Counter()
    for g, _, v in rows:
        totals[g] += v
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["offset"] == at.get(r["g"], 0) and r["total"] == totals[r["g"]]
        at[r["g"]] = at.get(r["g"], 0) + r["v"]
    assert len(got) == 3000
    assert with_offsets(spark.createDataFrame([], "g string, k bigint"), ["g"], ["k"]).count() == 0


def test_totals_of_hot_keys(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, i % 7) for i in range(2000)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, m bigint, v int")
    totals, n = Counter(), Counter()
    for k, _, v in rows:
        totals[k] += v
        n[k] += 1
    out = with_key_totals(df, ["k"], "m", {"t": F.col("v"), "n": F.lit(1)}).collect()
    assert len(out) == 2000 and all((r["t"], r["n"]) == (totals[r["k"]], n[r["k"]]) for r in out)
    grouped = grouped_with_totals(df.unionByName(df), ["k"], "m", {"c": F.count("*")}, {"members": F.lit(1), "rows": F.col("c")}).collect()
    assert len(grouped) == 2000 and all((r["c"], r["members"], r["rows"]) == (2, n[r["k"]], 2 * n[r["k"]]) for r in grouped)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(500, 500), (None, 3), (7, 6)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(label)):
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
