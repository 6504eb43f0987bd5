import math

import pytest
from pyspark.sql import functions as F

from chunkwright.functions import text as tx
from chunkwright.functions import vector as vx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("The cat's 2nd—NAP", ["the", "cat", "s", "2nd", "nap"]), ("", []), ("  ...  ", []), ("Ünïcode x²_y", ["ünïcode", "x²", "y"]), (None, None)],
)
def test_terms(spark, text, want):
    assert one(spark, tx.terms(F.col("t")), t=("string", text)) == want


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("a.pdf", "X > Y", "Y", "t"), "Document: a.pdf\nSection: X > Y\n\nt"), (("a.pdf", "", "Y", "t"), "Document: a.pdf\nSection: Y\n\nt"),
        (("a.pdf", None, None, "t"), "Document: a.pdf\n\nt"), (("", "", "", "t"), "t"), ((None, None, "S", None), "Section: S\n\n"),
    ],
)
def test_embedding_text(spark, row, want):
    names = ("d", "p", "s", "t")
    got = one(spark, tx.embedding_text(*[F.col(n) for n in names]), **{n: ("string", v) for n, v in zip(names, row)})
    assert got == want


@pytest.mark.parametrize(
    ("document", "path", "section", "want"),
    [("d", "p", "s", "[Source: d, Section: p, Pages: 1-2]\nt\n\n"), ("d", "d", "s", "[Source: d, Section: s, Pages: 1-2]\nt\n\n"), ("d", "", "d", "[Source: d, Pages: 1-2]\nt\n\n"), ("d", None, None, "[Source: d, Pages: 1-2]\nt\n\n")],
)
def test_context_entry(spark, document, path, section, want):
    got = one(spark, tx.context_entry(F.col("d"), F.col("p"), F.col("s"), F.lit(1), F.lit(2), F.lit("t")), d=("string", document), p=("string", path), s=("string", section))
    assert got == want


def test_small_text_columns(spark):
    assert one(spark, tx.spaces_normalized(F.col("t")), t=("string", " a \n\t b ")) == "a b"
    assert one(spark, tx.is_bold_font(F.col("t")), t=("string", "Serif-DemiBold")) and not one(spark, tx.is_bold_font(F.col("t")), t=("string", None))
    assert one(spark, tx.is_italic_font(F.col("t")), t=("string", "X-Oblique"))
    assert one(spark, tx.color_key(F.lit("rgb"), F.array(F.lit(0.5), F.lit(1.0), F.lit(0.0))), t=("int", 1)) == "0.50_1.00_0.00"
    assert one(spark, tx.color_key(F.lit("gray"), F.array(F.lit(0.5))), t=("int", 1)) == "gray_0.50"
    assert one(spark, tx.fence_stripped(F.col("t")), t=("string", "```json\n[1, [2]]\n```")) == "[1, [2]]"
    assert one(spark, tx.fence_stripped(F.col("t")), t=("string", "x [1]")) == "x [1]"
    assert one(spark, tx.page_list(F.array(F.lit(3), F.lit(1))), t=("int", 1)) == "1,3"


def test_cosine(spark):
    kinds = {"a": ("array<float>", [3.0, 4.0]), "b": ("array<float>", [4.0, 3.0])}
    assert abs(one(spark, vx.cosine(F.col("a"), F.col("b")), **kinds) - 0.96) < 1e-9
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=("array<float>", [0.0, 0.0]), b=("array<float>", [1.0, 0.0])) == 0
    assert one(spark, vx.cosine(F.col("a"), F.col("b")), a=("array<float>", None), b=("array<float>", [1.0])) is None
    with pytest.raises(Exception, match="different lengths"):
        one(spark, vx.cosine(F.col("a"), F.col("b")), a=("array<float>", [1.0]), b=("array<float>", [1.0, 0.0]))
    assert [round(x, 6) for x in one(spark, vx.unit(F.col("a")), a=("array<float>", [3.0, 4.0]))] == [0.6, 0.8]
    for bad in (None, [], [1.0], [0.0, 0.0], [math.nan, 1.0], [math.inf, 1.0], [None, 1.0]):
        assert not one(spark, vx.is_usable(F.col("a"), 2), a=("array<float>", bad))


def test_worked_examples(spark):
    assert abs(one(spark, vx.idf(F.lit(10), F.lit(0)), t=("int", 1)) - 3.091042) < 1e-6
    assert abs(one(spark, vx.idf(F.lit(10), F.lit(10)), t=("int", 1)) - 0.046520) < 1e-6
    assert abs(one(spark, vx.tf_saturation(F.lit(2), F.lit(7), F.lit(7.0)), t=("int", 1)) - 1.375) < 1e-12
    assert abs(one(spark, vx.reciprocal_rank(F.lit(1)) + vx.reciprocal_rank(F.lit(3)), t=("int", 1)) - 0.032266) < 1e-6
    assert one(spark, vx.sigmoid(F.lit(0.0)), t=("int", 1)) == 0.5
