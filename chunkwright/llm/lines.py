"""Problem 6: lines repeated across one source's records.

PrefixSpan over the sequences of line identifiers, as joins and aggregations. Patterns of
length one are the lines that are in enough records of their source; records projected on a
pattern (where its first embedding ends) give the lines that come after, and what has enough
records again is a pattern one longer. Only closed sequences are mined, those that no longer
sequence of the same records contains (BIDE, Wang and Han, 2004): a prefix is given up where
some line stands in the same gap of it in all its records, so a passage of n lines takes n
steps, not 2 ** n patterns. Every frequent line is part of a closed sequence in each record
that has it; the lines of the mined sequences are what is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwright.operators.skew import grouped_with_totals, with_key_totals
from chunkwright.session import checkpointed

MIN_ROWS = 10

#: White space as Unicode has it.
SPACES = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}]+"


def line_form(line: Column) -> Column:
    """What two lines have in common if they are the same: trimmed, runs of white space as one space, lower case, runs of digits as one 0."""
    spaced = F.trim(F.regexp_replace(line, SPACES, " "))
    return F.regexp_replace(F.lower(spaced), "[0-9]+", "0")


def line_rows(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(``key``, source, line_no, form, a, b) for each line that isn't empty; a and b are 128 bits that stand for source and form."""
    lines = df.where(F.col(source).isNotNull()).select(F.col(key), F.col(source).alias("source"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "_line"))
    formed = lines.withColumn("form", line_form(F.col("_line"))).where("form != ''").drop("_line")
    return formed.withColumn("a", F.xxhash64("source", "form")).withColumn("b", F.xxhash64("form", F.lit("|"), "source"))


def frequent_lines(df: DataFrame, key: str = "chunk_no", text: str = "text", source: str = "source_document", min_rows: int = MIN_ROWS) -> DataFrame:
    """(``key``, a, b, lines, rows, times): the lines of each record that are in ``min_rows`` records of its source at least, with their numbers, and how often they occur in the source."""
    rows = line_rows(df.where(F.col(key).isNotNull()), key, text, source).select(key, "a", "b", "line_no")
    return grouped_with_totals(rows, ["a", "b"], key, {"lines": F.sort_array(F.collect_list("line_no"))}, {"rows": F.lit(1), "times": F.size("lines")}).where(F.col("rows") >= min_rows)


def _gap_items(pattern: Column, at: Column, seq: Column) -> Column:
    """Of a record's (no, item) sequence, the different (gap, item, early) that stand in the gaps of a pattern.

    Gap i reaches from the end of the first embedding of the i items before to the last
    place where item i still leaves room for those after it; ``early`` is set for what stands
    there even if the pattern has to end where its first embedding does.
    """
    last_of = lambda item, before: F.array_max(F.transform(F.filter(seq, lambda s: (s["item"] == item) & (s["no"] < before)), lambda s: s["no"]))
    rest = F.reverse(F.slice(pattern, F.lit(1), F.size(pattern) - 1))
    places = lambda end: F.aggregate(rest, F.array(end), lambda done, item: F.concat(F.array(last_of(item, done[0])), done))
    end = F.element_at(at, -1)
    early, late = places(end), places(last_of(F.element_at(pattern, -1), F.lit(2**31 - 1)))

    def gap(upto: Column, i: Column) -> Column:
        after = F.when(i == 0, F.lit(-1)).otherwise(F.get(at, i - 1))
        inside = F.filter(seq, lambda s: (s["no"] > after) & (s["no"] < upto))
        return F.transform(inside, lambda s: F.struct(i.alias("gap"), s["item"].alias("item"), (s["no"] < F.get(early, i)).alias("early")))

    both = F.array_distinct(F.flatten(F.transform(late, gap)))
    # what stands in a gap both early and late counts once, as early
    return F.filter(both, lambda g: g["early"] | ~F.array_contains(both, F.struct(g["gap"].alias("gap"), g["item"].alias("item"), F.lit(True).alias("early"))))


def prefix_span(frequent: DataFrame, key: str = "chunk_no", min_rows: int = MIN_ROWS) -> DataFrame:
    """(``key``, pattern, at, rows): each closed frequent sequence's first embedding in each record that has it.

    ``pattern`` is the array of line identifiers and ``at`` the array of line numbers, as
    long as each other. Sequences are of any length and their lines stand any number of
    lines apart; mining ends when no longer sequence reaches the support. A sequence is left
    out only where a longer one holds it in all its records. Since identifiers include the
    source, support is counted inside each source. ``frequent`` is read several times.
    """
    item = F.struct("a", "b")
    each = frequent.select(key, F.explode("lines").alias("no"), item.alias("item"))
    records = checkpointed(each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "item"))).alias("_seq")))
    level = frequent.select(key, F.array(item).alias("pattern"), F.array(F.array_min("lines")).alias("at"), "rows")
    level = _named(level)
    out = None
    while True:
        seen = level.join(records, key)
        gaps = seen.select("_p", "_q", "rows", F.explode(_gap_items(F.col("pattern"), F.col("at"), F.col("_seq"))).alias("_g"))
        held = gaps.groupBy("_p", "_q", "_g.gap", "_g.item").agg(F.first("rows").alias("_n"), F.count(F.lit(1)).alias("_all"), F.count_if("_g.early").alias("_early"))
        # a line in the same gap of all records: a longer sequence has them all; if early, so has every growth of this one
        held = checkpointed(held.where("_all = _n").groupBy("_p", "_q").agg(F.max(F.col("_early") == F.col("_n")).alias("_stop")))
        kept = seen.join(held.where("_stop").select("_p", "_q"), ["_p", "_q"], "left_anti")
        later = F.filter("_seq", lambda s: s["no"] > F.element_at("at", -1))
        after = kept.withColumn("_after", later).withColumn("_items", F.transform("_after", lambda s: s["item"]))
        after = after.select(key, "pattern", "at", "_after", "_items", F.col("_p").alias("_pp"), F.col("_q").alias("_pq"), F.explode(F.array_distinct("_items")).alias("_next"))
        first = F.element_at("_after", F.array_position("_items", F.col("_next")).cast("int"))["no"]
        longer = _named(after.select(key, F.concat("pattern", F.array("_next")).alias("pattern"), F.concat("at", F.array(first)).alias("at"), "_pp", "_pq"))
        grown = checkpointed(with_key_totals(longer, ["_p", "_q"], key, {"rows": F.lit(1)}).where(F.col("rows") >= min_rows))
        covered = grown.groupBy(F.col("_pp").alias("_p"), F.col("_pq").alias("_q")).agg(F.max("rows").alias("_most"))
        closed = level.join(held.select("_p", "_q"), ["_p", "_q"], "left_anti").join(covered, ["_p", "_q"], "left").where("_most IS NULL OR _most < rows")
        closed = closed.select(key, "pattern", "at", "rows")
        out = closed if out is None else out.unionByName(closed)
        if grown.isEmpty():
            return out
        level = grown.drop("_pp", "_pq")


def _named(level: DataFrame) -> DataFrame:
    """With 128 bits that stand for the pattern."""
    return level.withColumn("_p", F.xxhash64("pattern")).withColumn("_q", F.xxhash64(F.reverse("pattern"), F.lit("|")))


def repeated_lines(df: DataFrame, key: str = "chunk_no", text: str = "text", source: str = "source_document", min_rows: int = MIN_ROWS) -> DataFrame:
    """(``key``, line_no, rows, length): every occurrence of a line of a mined sequence in the records that hold the sequence, the records of its source that have the line, and the length of the longest sequence it is deleted with.

    Rows that share a key are one record. Null sources have no repeated lines; null and
    empty texts and empty lines take no part.
    """
    frequent = checkpointed(frequent_lines(df, key, text, source, min_rows))
    mined = prefix_span(frequent, key, min_rows).select(key, F.explode("pattern").alias("_i"), F.size("pattern").alias("_length"))
    mined = mined.groupBy(key, "_i.a", "_i.b").agg(F.max("_length").alias("length"))
    return frequent.join(mined, [key, "a", "b"]).select(key, F.explode(F.array_distinct("lines")).alias("line_no"), "rows", "length")


def without_repeated_lines(df: DataFrame, key: str = "chunk_no", text: str = "text", source: str = "source_document", min_rows: int = MIN_ROWS) -> DataFrame:
    """Every row, its ``text`` without the lines repeated in its source, with ``lines_removed``.

    Rows keep all columns; one already called lines_removed is replaced. A row of which
    nothing is left has an empty text; null stays null.
    """
    numbers = repeated_lines(df, key, text, source, min_rows).groupBy(key).agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed(key, "_key")
    joined = df.drop("lines_removed").join(numbers, F.col(key) == F.col("_key"), "left")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(gone, i)), "\n")
    return joined.withColumn(text, F.when(F.size(gone) > 0, kept).otherwise(F.col(text))).withColumn("lines_removed", F.size(gone)).drop("_key", "_gone")
