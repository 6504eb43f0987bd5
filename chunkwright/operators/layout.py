"""Words of a page layout to lines, heading levels and sections.

Everything is windows over a document's words in their order: no state is carried by hand.
A document's words are one window partition; documents are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.text import heading_path


def _order() -> Window:
    return Window.partitionBy("document").orderBy("ord")


def line_breaks(words: DataFrame, by: tuple[str, ...] = ("document", "page")) -> DataFrame:
    """Words with ``separator``: what stands between a word and the one before it on its page (or other unit), null for the first.

    Word boxes on one height are a line. A gap of more than 1.5 mean heights begins a new
    line; one of more than 0.3 does so behind a sentence end or a list marker.
    """
    before = Window.partitionBy(*by).orderBy("ord")
    p_top, p_bottom, p_text = F.lag("top").over(before), F.lag("bottom").over(before), F.lag("text").over(before)
    height = (F.abs(F.col("top") - F.col("bottom")) + F.abs(p_top - p_bottom)) / 2
    height = F.when(height < 1, F.lit(10.0)).otherwise(height)
    gap = p_bottom - F.col("top")
    level = (F.abs(p_bottom - F.col("bottom")) < height * 0.3) & (F.abs(p_top - F.col("top")) < height * 0.3)
    closed = F.rtrim(p_text)
    ends = closed.rlike(r"[.?!:;]$") | closed.rlike(r"(?s)^[0-9].*[.)]$")
    broken = ~level & ((gap > height * 1.5) | ((gap > height * 0.3) & ends))
    return words.withColumn("separator", F.when(p_text.isNull(), F.lit(None)).when(broken, F.lit("\n")).otherwise(F.lit(" ")))


def joined_words(ordered: Column) -> Column:
    """Text of an array of (ord, separator, text): separators between words, none before the first."""
    return F.array_join(F.transform(F.array_sort(ordered), lambda w, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.coalesce(w["separator"], F.lit(" "))), w["text"])), "")


def page_texts(words: DataFrame) -> DataFrame:
    """(document, page, text_spaced, text_lines): each page's words with single spaces, and with line breaks where the layout has them."""
    placed = line_breaks(words).groupBy("document", "page").agg(F.collect_list(F.struct("ord", "separator", "text")).alias("_w"))
    spaced = F.array_join(F.transform(F.array_sort("_w"), lambda w: w["text"]), " ")
    return placed.select("document", "page", spaced.alias("text_spaced"), joined_words(F.col("_w")).alias("text_lines"))


def simple_sections(words: DataFrame, skip_pages: int = 0) -> DataFrame:
    """One section for each document, of all its pages with ink; it ends on the document's last page."""
    if skip_pages < 0:
        raise ValueError("pages to skip can't be negative")
    last = words.groupBy("document").agg(F.max("page").alias("end_page"))
    pages = page_texts(words.where(F.col("page") > skip_pages)).where(F.col("text_lines").rlike(r"\S"))
    whole = pages.groupBy("document").agg(F.min("page").alias("start_page"), F.array_sort(F.collect_list(F.struct(F.col("page").alias("page_number"), F.col("text_lines").alias("text")))).alias("page_texts"))
    return whole.join(last, "document").select("document", F.lit(0).alias("section_ord"), F.lit("").alias("heading"), F.lit("").alias("heading_path"), F.lit(1).alias("level"), "start_page", "end_page", "page_texts")


def body_font_size(words: DataFrame) -> DataFrame:
    """(document, body_size): the most frequent font size to one decimal (half to even); of sizes as frequent, the one met first."""
    counted = words.groupBy("document", F.bround("font_size", 1).alias("body_size")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = F.min_by("body_size", F.struct(-F.col("n"), "first"))
    return counted.groupBy("document").agg(best.alias("body_size"))


def font_sizes(words: DataFrame) -> DataFrame:
    """(document, average, largest, smallest) font size."""
    return words.groupBy("document").agg(F.avg("font_size").alias("average"), F.max("font_size").alias("largest"), F.min("font_size").alias("smallest"))


def heading_sizes(words: DataFrame, max_size: float | None = None, color: str | None = None) -> DataFrame:
    """(document, body_size, sizes): rounded sizes of what is larger than 1.1 times the body, descending; only of one colour and up to a size if given."""
    body = body_font_size(words)
    large = words.join(body, "document").where(F.col("font_size") > F.col("body_size") * 1.1)
    if color:
        large = large.where(F.col("color_key") == color)
    if max_size is not None:
        large = large.where(F.col("font_size") <= max_size)
    sizes = large.groupBy("document").agg(F.sort_array(F.collect_set(F.bround("font_size", 1)), asc=False).alias("sizes"))
    return body.join(sizes, "document", "left").select("document", "body_size", F.coalesce("sizes", F.array().cast("array<double>")).alias("sizes"))


def heading_levels(words: DataFrame, max_size: float | None = None, color: str | None = None) -> DataFrame:
    """Words with ``heading_level``: 1 for the largest heading size and so on, one more than there are sizes for bold words of body size or larger, else 0."""
    known = words.join(heading_sizes(words, max_size, color), "document")
    sizes = F.filter("sizes", lambda s: s <= max_size) if max_size is not None else F.col("sizes")
    at = F.array_position(sizes, F.bround("font_size", 1))
    level = F.when(at > 0, at).when(F.col("is_bold") & (F.col("font_size") >= F.col("body_size")), F.size(sizes) + 1).otherwise(0)
    if color:
        level = F.when(F.col("color_key").eqNullSafe(F.lit(color)), level).otherwise(0)
    if max_size is not None:
        level = F.when(F.col("font_size") > max_size, 0).otherwise(level)
    return known.withColumn("heading_level", level.cast("int")).drop("body_size", "sizes")


def format_sections(words: DataFrame, max_depth: int = 1, max_size: float | None = None, skip_pages: int = 0, color: str | None = None) -> DataFrame:
    """Sections by font: (document, section_ord, heading, heading_path, heading_font_size, heading_is_bold, level, start_page, end_page, page_texts).

    A heading is a run of words of a heading's level on one page whose sizes are within 0.5
    of each other; the words up to the next heading are its section. A heading that another
    one follows at once has no section and no place in paths. Words before the first heading
    are a section without one. Words larger than ``max_size`` and pages up to ``skip_pages``
    are left out.
    """
    if max_depth < 1 or skip_pages < 0 or (max_size is not None and max_size <= 0):
        raise ValueError("the depth and the largest size must be positive, pages to skip not negative")
    kept = words.where(F.col("page") > skip_pages).where(F.col("text").rlike(r"\S"))
    if max_size is not None:
        kept = kept.where(F.col("font_size") <= max_size)
    leveled = heading_levels(kept, max_size, color).withColumn("_h", (F.col("heading_level") > 0) & (F.col("heading_level") <= max_depth))
    w = _order()
    goes_on = F.col("_h") & F.lag("_h").over(w) & (F.abs(F.col("font_size") - F.lag("font_size").over(w)) < 0.5) & (F.col("page") == F.lag("page").over(w))
    marked = leveled.withColumn("_new", (F.col("_h") & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_new") == 1
    heads = marked.groupBy("document", "_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h"), F.struct("ord", "text")))), lambda x: x["text"]), " ").alias("_title"),
        F.max(F.when(first, F.col("font_size"))).alias("heading_font_size"), F.coalesce(F.bool_or(F.when(first, F.col("is_bold"))), F.lit(False)).alias("heading_is_bold"),
        F.coalesce(F.max(F.when(first, F.col("heading_level"))), F.lit(1)).alias("level"), F.coalesce(F.max(F.when(first, F.col("page"))), F.lit(1)).alias("start_page"),
        F.count_if(~F.col("_h")).alias("_body"), F.max("_new").alias("_headed"),
    )
    registered = heads.where("_body > 0").withColumn("_title", F.when(F.col("_headed") == 1, F.trim("_title")))
    # the last heading of each level, unless one of a lower level has come since
    by = Window.partitionBy("document").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    paths, lower = registered, None
    for depth in range(1, max_depth + 1):
        here = (F.col("level") == depth) & F.col("_title").isNotNull()
        paths = paths.withColumn(f"_at{depth}", F.last(F.when(here, F.col("_id")), ignorenulls=True).over(by)).withColumn(f"_name{depth}", F.last(F.when(here, F.col("_title")), ignorenulls=True).over(by))
    parts = []
    for depth in range(1, max_depth + 1):
        alive = F.col("level") >= depth
        if lower is not None:
            alive = alive & (F.col(f"_at{depth}") > F.coalesce(lower, F.lit(-1)))
        parts.append(F.when(alive, F.col(f"_name{depth}")))
        lower = F.col(f"_at{depth}") if lower is None else F.greatest(lower, F.col(f"_at{depth}"))
    paths = paths.withColumn("heading_path", F.when(F.col("_title").isNotNull(), heading_path(*parts)).otherwise("")).withColumn("heading", F.coalesce("_title", F.lit("")))
    body = line_breaks(marked.where(~F.col("_h")), ("document", "_id", "page"))
    pages = body.groupBy("document", "_id", "page").agg(F.collect_list(F.struct("ord", "separator", "text")).alias("_w"))
    pages = pages.select("document", "_id", F.col("page").alias("page_number"), F.trim(joined_words(F.col("_w"))).alias("text"))
    texts = pages.groupBy("document", "_id").agg(F.max("page_number").alias("end_page"), F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("page_texts"))
    out = paths.join(texts, ["document", "_id"])
    return out.select("document", F.col("_id").cast("int").alias("section_ord"), "heading", "heading_path", "heading_font_size", "heading_is_bold", "level", "start_page", "end_page", "page_texts")
