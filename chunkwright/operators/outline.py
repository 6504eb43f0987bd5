"""Sections by a document's outline: its bookmarks, and where their titles stand on the pages.

Each bookmark looks at a few pages only: the page it names, the two after it and the one
before. Those pages are joined to it and searched in one Arrow function for each bookmark;
the end of a section is the next bookmark's place, by a window.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages after the named one that are searched for a title.
PAGES_AFTER = 2
#: How much longer than the next word a gap between two words of a title may be.
GAP = 10


def find_title(page: str, title: str) -> int:
    """Where a title begins on a page, in any case: as it stands, else as its words in order with short gaps between; -1 if nowhere.

    A word that is nowhere in the rest of the page ends the search without a find; a title
    that the page's end cuts off counts as found.
    """
    words = title.split()
    if not page or not words:
        return -1
    low, wanted = page.lower(), [w.lower() for w in words]
    at = low.find(title.lower())
    if at >= 0:
        return at
    begin = 0
    while begin < len(page):
        first = end = low.find(wanted[0], begin)
        if first < 0:
            return -1
        end += len(wanted[0])
        begin = end
        for word in wanted[1:]:
            if end >= len(page):
                return first
            found = low.find(word, end)
            if found < 0:
                return -1
            if found - end > len(word) + GAP:
                break
            end = found + len(word)
        else:
            return first
    return -1


def title_end(page: str, title: str, at: int) -> int:
    """Where the text behind a title found at ``at`` begins: white space skipped, words matched one by one if the title doesn't stand there literally."""
    if not page or not title or at < 0:
        return at
    end = at
    if page[at : at + len(title)].lower() == title.lower():
        end = at + len(title)
    else:
        for word in title.split():
            found = page.lower().find(word.lower(), end)
            if found < 0:
                break
            end = found + len(word)
    return end + len(page[end:]) - len(page[end:].lstrip())


def same_place(spaced: str, lined: str, at: int) -> int:
    """The place in ``lined`` that has as many characters of ink before it as ``at`` has in ``spaced``: right behind the last of them."""
    if at <= 0 or not spaced or not lined:
        return max(at, 0)
    ink = len("".join(spaced[:at].split()))
    if not ink:
        return 1
    seen = 0
    for m in regex.finditer(r"\S+", lined):
        if seen + m.end() - m.start() >= ink:
            return m.start() + ink - seen
        seen += m.end() - m.start()
    return len(lined)


def flattened(bookmarks: DataFrame, max_depth: int = 1, skip_pages: int = 0) -> DataFrame:
    """Bookmarks as (document, ord, title, full_title, level, page): trimmed, up to a level, without those of skipped pages and what lies below them.

    Pages that are missing are 1. The order is by page, level and the outline's own order.
    Exact repeats of a bookmark are one.
    """
    if max_depth < 1 or skip_pages < 0:
        raise ValueError("the depth must be positive, pages to skip not negative")
    once = bookmarks.dropDuplicates(["document", "ord", "title", "level", "page", "parent_titles"])
    named = once.select("document", "ord", F.trim("title").alias("title"), "level", F.coalesce("page", F.lit(1)).alias("page"), F.concat(F.coalesce("parent_titles", F.array().cast("array<string>")), F.array(F.trim("title"))).alias("_path"))
    kept = named.where((F.col("level") <= max_depth) & (F.col("page") > skip_pages))
    if skip_pages:
        skipped = named.where(F.col("page") <= skip_pages).select(F.col("document").alias("_d"), F.col("_path").alias("_gone")).distinct()
        # an ancestor's path is a beginning of its descendants' paths
        above = kept.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.size("_path")), lambda i: F.slice("_path", F.lit(1), i))))
        below = above.join(skipped, (F.col("document") == F.col("_d")) & (F.col("_p") == F.col("_gone")), "left_semi").select("document", "ord").distinct()
        kept = kept.join(below, ["document", "ord"], "left_anti")
    place = Window.partitionBy("document").orderBy("page", "level", "ord", "title")
    return kept.select("document", (F.row_number().over(place) - 1).cast("bigint").alias("ord"), "title", F.array_join("_path", " > ").alias("full_title"), "level", "page")


def followed(outline: DataFrame, *columns: str) -> DataFrame:
    """The outline with the given columns of the bookmark that comes next in the document as next_...; null for the last."""
    order = Window.partitionBy("document").orderBy("ord")
    return outline.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])


def located(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """The outline with ``start_page``, ``start`` and ``content``: where each title stands and where the text behind it begins, in the page's spaced text.

    The first find counts, on the named page, then the following, then the one before. A
    title found nowhere is taken to stand at the beginning of its page.
    """
    steps = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(step).alias("step")) for i, step in enumerate([*range(PAGES_AFTER + 1), -1])])
    looks = outline.select("document", "ord", "title", F.explode(steps).alias("_s"), "page")
    looks = looks.select("document", "ord", "title", F.col("_s.priority").alias("priority"), (F.col("page") + F.col("_s.step")).alias("page"))
    seen = looks.join(pages.select("document", "page", "text_spaced"), ["document", "page"])

    @F.pandas_udf(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    def find(page: pd.Series, title: pd.Series) -> pd.DataFrame:
        at = [find_title(p or "", t or "") for p, t in zip(page, title, strict=True)]
        return pd.DataFrame({"at": at, "end": [title_end(p or "", t or "", a) for p, t, a in zip(page, title, at, strict=True)]})

    tried = seen.withColumn("_f", find("text_spaced", "title"))
    found = tried.where("_f.at >= 0").groupBy("document", "ord").agg(F.min_by(F.struct("page", "_f.at", "_f.end"), "priority").alias("_hit"))
    unfound = tried.where("priority = 0").select("document", "ord", title_end_at_start(F.col("text_spaced"), F.col("title")).alias("_zero"))
    out = outline.join(found, ["document", "ord"], "left").join(unfound, ["document", "ord"], "left")
    return out.select(*outline.columns, F.coalesce("_hit.page", "page").alias("start_page"), F.coalesce("_hit.at", F.lit(0)).alias("start"), F.coalesce("_hit.end", "_zero", F.lit(0)).alias("content"))


@F.pandas_udf(T.IntegerType())
def title_end_at_start(page: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([title_end(p or "", t or "", 0) for p, t in zip(page, title, strict=True)])


def outline_sections(bookmarks: DataFrame, pages: DataFrame, max_depth: int = 1, skip_pages: int = 0) -> DataFrame:
    """Sections between bookmarks: (document, section_ord, heading, heading_path, level, start_page, end_page, page_texts).

    ``pages`` has document, page, text_spaced and text_lines. A section begins behind its
    title and ends before the next bookmark's, or on the document's last page. Sections
    without text don't come out. A document without bookmarks has no sections here; asking
    for one alone is an error of the service.
    """
    pages = pages.where(F.col("page") > skip_pages)
    marks = located(flattened(bookmarks, max_depth, skip_pages), pages)
    last = pages.groupBy("document").agg(F.max("page").alias("last_page"))
    # whether the next title was found or not, its place ends this section
    bounded = followed(marks.join(last, "document"), "start_page", "start")
    until = F.coalesce("next_start_page", "last_page")
    spread = bounded.where(until >= F.col("start_page")).withColumn("page", F.explode(F.sequence("start_page", until)))
    placed = spread.join(pages, ["document", "page"]).where("text_spaced != ''")

    @F.pandas_udf(T.StringType())
    def cut(first: pd.Series, final: pd.Series, content: pd.Series, next_start: pd.Series, spaced: pd.Series, lined: pd.Series) -> pd.Series:
        out = []
        for is_first, is_final, behind, stop, s, t in zip(first, final, content, next_start, spaced, lined, strict=True):
            begin = same_place(s, t, int(behind)) if is_first and behind > 0 else 0
            text = t[begin:].lstrip() if 0 < begin < len(t) else t
            if is_final:
                end = same_place(s, t, int(stop))
                if stop == 0 or end <= begin:
                    out.append(None)
                    continue
                if begin and end - begin < len(text):
                    text = text[: end - begin].strip()
                elif not begin and end < len(t):
                    text = t[:end].strip()
            out.append(text if text.strip() else None)
        return pd.Series(out, dtype=object)

    final = F.coalesce(F.col("page") == F.col("next_start_page"), F.lit(False))
    texts = placed.withColumn("text", cut(F.col("page") == F.col("start_page"), final, "content", F.coalesce("next_start", F.lit(0)), "text_spaced", "text_lines")).where("text IS NOT NULL")
    keys = ["document", "ord", "title", "full_title", "level", "start_page"]
    whole = texts.groupBy(*keys).agg(F.max("page").alias("end_page"), F.array_sort(F.collect_list(F.struct(F.col("page").alias("page_number"), "text"))).alias("page_texts"))
    return whole.select("document", F.col("ord").cast("int").alias("section_ord"), F.col("title").alias("heading"), F.col("full_title").alias("heading_path"), "level", "start_page", "end_page", "page_texts")
