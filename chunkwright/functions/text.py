"""Text as column expressions: terms, sizes, headers, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term is a maximal run of Unicode letters and digits; this matches what lies between terms.
BETWEEN_TERMS = r"[^\p{L}\p{N}]+"

#: Something other than white space.
INK = r"[^\s\p{Z}\x{1C}-\x{1F}]"


def terms(text: Column) -> Column:
    """Terms of the lower-cased text in order, repeats kept; null for null."""
    return F.filter(F.split(F.lower(text), BETWEEN_TERMS), lambda t: t != F.lit(""))


def size_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer: the UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def has_ink(text: Column) -> Column:
    """Whether there is anything but white space; false for null."""
    return F.coalesce(text.rlike(INK), F.lit(False))


def spaces_normalized(text: Column) -> Column:
    """Trimmed, and each run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def _filled(column: Column) -> Column:
    return column.isNotNull() & (column != F.lit(""))


def embedding_text(document: Column, path: Column, section: Column, text: Column) -> Column:
    """What is embedded for a chunk: a header of document and section path (the section's own name where there is no path), a blank line, the text."""
    where = F.when(_filled(path), path).when(_filled(section), section)
    header = F.concat(F.when(_filled(document), F.concat(F.lit("Document: "), document, F.lit("\n"))).otherwise(""), F.when(where.isNotNull(), F.concat(F.lit("Section: "), where, F.lit("\n"))).otherwise(""))
    return F.concat(F.when(header != "", F.concat(header, F.lit("\n"))).otherwise(""), F.coalesce(text, F.lit("")))


def context_entry(document: Column, path: Column, section: Column, start: Column, end: Column, text: Column) -> Column:
    """A chunk as it is cited: its source in brackets, then its text. The section is named only if it says more than the document."""
    tells = lambda c: _filled(c) & ~c.eqNullSafe(document)
    named = F.when(tells(path), path).when(tells(section), section)
    source = F.concat(F.lit("[Source: "), F.coalesce(document, F.lit("")), F.coalesce(F.concat(F.lit(", Section: "), named), F.lit("")), F.lit(", Pages: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("]\n"))
    return F.concat(source, F.coalesce(text, F.lit("")), F.lit("\n\n"))


def heading_path(*titles: Column) -> Column:
    """Titles from the outermost to the innermost, nulls left out."""
    return F.concat_ws(" > ", *titles)


def is_bold_font(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("bold|heavy|black|demi"), F.lit(False))


def is_italic_font(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("italic|oblique|slant"), F.lit(False))


def color_key(space: Column, parts: Column) -> Column:
    """A colour as text: R_G_B, gray_G, cmyk_C_M_Y_K with two decimals each, or default."""
    two = F.array_join(F.transform(parts, lambda x: F.format_string("%.2f", x.cast("double"))), "_")
    return F.when(space == "rgb", two).when(space.isin("gray", "cmyk"), F.concat(space, F.lit("_"), two)).otherwise("default")


def fence_stripped(content: Column) -> Column:
    """The JSON array inside a fenced block; text that doesn't begin with a fence stays as it is."""
    trimmed = F.regexp_replace(content, r"^\s+|\s+$", "")
    inside = F.regexp_extract(trimmed, r"(?s)(\[.*\])", 1)
    return F.when(trimmed.startswith("```") & (inside != ""), inside).otherwise(trimmed)


def term_index(term: Column) -> Column:
    """A term as a number below 2 ** 32: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def page_list(pages: Column) -> Column:
    """Page numbers as they stand in metadata: in order, with commas."""
    return F.array_join(F.transform(F.array_sort(pages), lambda p: p.cast("string")), ",")
