import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chunkwright.llm.canonical import canonical_arrow, canonicalize, same_reading
from chunkwright.llm.pairs import class_pairs


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["canonical"] for r in canonicalize(df).orderBy("doc_id").collect()]


def test_the_same_reading_gets_one_form(spark):
    same = [
        ["fine flow", "ﬁne ﬂow", "f​ine fl­ow", "ｆｉｎｅ flow", "fine flow", "fіne flоw", "fine flοw"],
        ["café", "café", "cafｅ́", "сafé"],
        ["Модель слова и дом", "Mодель cлова и дoм"],
        ["Ο κόσμος όλος", "O κόσμoς óλος"],
        ["ガイド", "ｶﾞｲﾄﾞ", "ガイド"],
        ["K", "K", "К", "Κ"],
    ]
    for group in same:
        assert len(set(forms(spark, group))) == 1, group


def test_different_readings_stay_apart(spark):
    texts = ["cafe", "café", "Cafe", "cafe ", "cafe.", "caf e", "caf  e", "cafe\n", "cafe1", "cafe²", "cafe2"]
    assert len(set(forms(spark, texts))) == len(texts)


def test_true_scripts_stay(spark):
    texts = ["Модель слова и дом, а не сон", "Ο κόσμος είναι εδώ, Α και Β", "これは本です。ガイド", "plain ASCII\ttext\r\n"]
    assert forms(spark, texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_null_empty_long_and_clashing_columns(spark):
    long = "аbc ｄ " * 200_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, long, "z"), (3, long, "z")], "doc_id bigint, text string, canonical string")
    rows = canonicalize(df).orderBy("doc_id").collect()
    assert [r["canonical"] for r in rows] == [None, "", "abc d " * 200_000, "abc d " * 200_000]
    assert canonicalize(df, out="text").columns == ["doc_id", "canonical", "text"]
    assert canonicalize(df.limit(0)).count() == 0
    again = canonicalize(canonicalize(df), "canonical", "twice")
    assert again.where("NOT canonical <=> twice").count() == 0


def test_batches_of_long_texts(spark):
    one = "Длинный текст о cистеме, кaк eго читают. " * 500
    df = spark.range(2000).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(one).alias("text"))
    assert canonicalize(df).select("canonical").distinct().count() == 1


def test_a_text_larger_than_a_slice_follows_the_whole_of_it():
    rng = random.Random(3)
    parts = ["Длинный ", "CO ", "кaк\n", "cafe\u0301, ", "plain text. ", "ﬁn ", "ОНА ", "\u200b", "Ж", "é。", "ガ"]
    for weights in ((9, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 9, 1, 1, 1, 1, 1, 1)):
        text = "".join(rng.choices(parts, weights, k=3000))
        batch = pa.RecordBatch.from_arrays([pa.array([None, text, "", text[:50]])], names=["text"])
        whole, cut = (next(canonical_arrow(iter([batch]), "text", "out", most=most)).column("out").to_pylist() for most in (1 << 20, 900))
        assert whole == cut and whole[1] != text and whole[0] is None and whole[2] == ""


def test_pairs_of_documents(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "аb"), (3, "ab"), (4, "a​b"), (5, "zz"), (6, None), (7, "zz")], "doc_id bigint, text string")
    classes = same_reading(df)
    got = {tuple(r) for r in class_pairs(classes, "doc_id", differ="variant").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}


@pytest.mark.parametrize("limit", [1, 3])
def test_large_classes_become_stars(spark, limit):
    rows = [(i, "c", "v%d" % (i % 2)) for i in range(10)] + [(20, "d", "v0"), (21, None, "v0")]
    df = spark.createDataFrame(rows, "k bigint, class_id string, v string")
    plain = {tuple(r) for r in class_pairs(df, "k", max_full=limit).collect()}
    assert plain == {(0, i) for i in range(1, 10)}
    differing = {tuple(r) for r in class_pairs(df, "k", differ="v", max_full=limit).collect()}
    assert differing == {(0, i) for i in range(1, 10, 2)} | {(1, i) for i in range(2, 10, 2)}
    assert class_pairs(df.limit(0), "k").count() == 0


def test_every_pair_of_a_large_class(spark):
    rows = [(i, "c", "v%d" % (i % 3)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k bigint, class_id string, v string")
    got = class_pairs(df, "k", differ="v")
    assert got.count() == got.distinct().count() == 3 * 500 * 500
    assert got.where("k_a % 3 = k_b % 3 OR k_a >= k_b").count() == 0
    star = {tuple(r) for r in class_pairs(df, "k", differ="v", max_full=10).collect()}
    assert {(0, 1), (0, 2), (1, 2)} <= star
