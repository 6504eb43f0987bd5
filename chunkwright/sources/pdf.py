"""Documents from files: a distributed scan with a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.functions.text import is_bold_font, is_italic_font
from chunkwright.schema import BOOKMARK, WORD

#: Gives a file's words in reading order as dicts with the columns of WORD except document and ord (bold and italic may be left out).
Parser = Callable[[bytes], Iterable[dict]]


#: Gives a file's bookmarks in the outline's order as dicts with title, level (from 1), page and parent_titles.
OutlineParser = Callable[[bytes], Iterable[dict]]


def scan(spark: SparkSession, paths: str | list[str], glob: str = "*.pdf", root: str | None = None) -> DataFrame:
    """(document, content) of files, their paths taken from ``root`` on if it is given; a path that doesn't exist is an error at once."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if root is not None:
        paths = [p if p.startswith("/") or "://" in p else f"{root.rstrip('/')}/{p}" for p in paths]
    jvm = spark._jvm.org.apache.hadoop.fs
    for p in paths:
        path = jvm.Path(p)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            raise FileNotFoundError(p)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("document"), "content")


def text_parser(content: bytes) -> Iterator[dict]:
    """Plain text as pages at form feeds: a line is 12 high, a line of # marks a heading of that level in larger type."""
    for page, body in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for row, line in enumerate(body.split("\n")):
            marks = len(line) - len(line.lstrip("#"))
            for word in line[marks:].split():
                yield {"page": page, "text": word, "font_name": "Plain", "font_size": 10.0 + (12 - 3 * marks if 0 < marks < 4 else 0), "color_key": "default", "top": 800.0 - 20 * row, "bottom": 788.0 - 20 * row}


def text_outline(content: bytes) -> Iterator[dict]:
    """The headings of ``text_parser``'s files as bookmarks."""
    above: list[str] = []
    for page, body in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for line in body.split("\n"):
            marks = len(line) - len(line.lstrip("#"))
            if 0 < marks < 4:
                above = above[: marks - 1]
                title = line[marks:].strip()
                yield {"title": title, "level": marks, "page": page, "parent_titles": list(above)}
                above.append(title)


def color_key_of(color: object) -> str:
    """The key of a fill colour as a PDF library gives it: a number or one, three or four of them from 0 to 1; anything else is the default."""
    parts = [color] if isinstance(color, (int, float)) else list(color) if isinstance(color, (tuple, list)) else []
    if not all(isinstance(p, (int, float)) for p in parts):
        return "default"
    prefix = {1: "gray_", 3: "", 4: "cmyk_"}.get(len(parts))
    return "default" if prefix is None else prefix + "_".join(f"{p:.2f}" for p in parts)


def _opened(content: bytes):  # noqa: ANN202
    import io

    try:
        import pdfplumber
    except ImportError as error:
        raise RuntimeError("no PDF library is installed; pass another parser") from error
    return pdfplumber.open(io.BytesIO(content))


def pdf_outline(content: bytes) -> Iterator[dict]:
    """Bookmarks of a PDF, if pdfplumber is there; those whose page can't be told have none."""
    with _opened(content) as pdf:
        numbers = {page.page_obj.pageid: page.page_number for page in pdf.pages}
        above: list[str] = []
        for level, title, goal, *_ in pdf.doc.get_outlines():
            above = above[: level - 1]
            target = goal[0] if isinstance(goal, (list, tuple)) and goal else None
            yield {"title": title, "level": level, "page": numbers.get(getattr(target, "objid", None)), "parent_titles": list(above)}
            above.append(title)


def pdf_parser(content: bytes) -> Iterator[dict]:
    """Words of a PDF, if pdfplumber is there."""
    with _opened(content) as pdf:
        for number, page in enumerate(pdf.pages, 1):
            for word in page.extract_words(extra_attrs=["fontname", "size", "non_stroking_color"]):
                yield {"page": number, "text": word["text"], "font_name": word["fontname"], "font_size": float(word["size"]), "color_key": color_key_of(word["non_stroking_color"]), "top": float(page.height - word["top"]), "bottom": float(page.height - word["bottom"])}


def words_of(files: DataFrame, parser: Parser) -> DataFrame:
    """The words of each file; those without a letter, digit or sign are left out."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, content in zip(batch["document"], batch["content"], strict=True):
                rows = [{"document": document, "ord": i, **w} for i, w in enumerate(parser(bytes(content)))]
                yield pd.DataFrame(rows, columns=["document", "ord", "page", "text", "font_name", "font_size", "color_key", "top", "bottom"])

    schema = "document string, ord bigint, page int, text string, font_name string, font_size double, color_key string, top double, bottom double"
    words = files.mapInPandas(parse, schema).where(F.col("text").rlike(r"\S"))
    return words.withColumn("is_bold", is_bold_font(F.col("font_name"))).withColumn("is_italic", is_italic_font(F.col("font_name"))).select(*[f.name for f in WORD])


def bookmarks_of(files: DataFrame, parser: OutlineParser) -> DataFrame:
    """The bookmarks of each file: (document, ord, title, level, page, parent_titles)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document, content in zip(batch["document"], batch["content"], strict=True):
                rows = [{"document": document, "ord": i, **b} for i, b in enumerate(parser(bytes(content)))]
                out = pd.DataFrame(rows, columns=[f.name for f in BOOKMARK])
                yield out.assign(page=out["page"].astype("Int32"))

    return files.mapInPandas(parse, BOOKMARK)
