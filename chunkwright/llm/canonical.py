"""Problem 9: visually identical text with different characters.

The normal form is computed by DuckDB inside the Arrow partitions of a Spark job, as one
embedded SQL expression: ``regexp_replace`` takes out what prints nothing and unfolds
ligatures, ``translate`` maps widths, kinds of space and look-alike letters,
``nfc_normalize`` composes accents.

Look-alikes are first brought to Latin everywhere, which gives texts that read the same
the same characters. A run of letters that holds a letter found only in Cyrillic (or only
in Greek) then gets its look-alikes back in that script; a run of look-alikes alone follows
the script of most such letters in the text. What decides is the same in every spelling of
a text, so equal texts stay equal, and true Cyrillic and Greek stay Cyrillic and Greek.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Memory of a partition's DuckDB, the bytes of text it gets at a time, and its memory for each byte of a part beyond that.
MEMORY_MB = 256
SLICE_BYTES = 4 << 20
MEMORY_FACTOR = 64
#: Where a text may be cut: no word and no composition of an accent reaches over the beginning of such a character.
BREAK = re.compile(r"[\t\n\r -/:-@\[-`{-~、。]")

# Letters of the same shape, each with its Latin twin below it.
CYRILLIC = "АВЕКМНОРСТУХЅІЈҺԌԚԜӀаеорсухѕіјһԁԛԝӏ"
CYR_LATIN = "ABEKMHOPCTYXSIJhGQWIaeopcyxsijhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXoj"

# Ranges of characters that print nothing.
INVISIBLE = (
    (0x0000, 0x0008), (0x000E, 0x001B), (0x007F, 0x0084), (0x0086, 0x009F), (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE007F), (0xE0100, 0xE01EF),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@cache
def _compatible() -> tuple[dict[str, str], dict[str, str]]:
    """Characters to one character, and to several: widths, spaces and ligatures, by their decompositions in Unicode."""
    one, more = {}, {}
    for code in range(0x10000):  # all of these kinds lie in the basic plane
        ch = chr(code)
        kind = unicodedata.decomposition(ch).partition(" ")[0]
        ligature = kind == "<compat>" and "LIGATURE" in unicodedata.name(ch, "") and not 0xFB50 <= code <= 0xFDFF
        if kind in ("<wide>", "<narrow>") or ligature or unicodedata.category(ch) == "Zs":
            to = " " if unicodedata.category(ch) == "Zs" else unicodedata.normalize("NFKC", ch)
            if to != ch:
                (one if len(to) == 1 else more)[ch] = to
    return one, more


def _composed(letters: str, latin: str) -> dict[str, str]:
    """The letters, and each of them composed with an accent, to their Latin twins with that accent, decomposed where there is no such letter."""
    pairs = dict(zip(letters, latin, strict=True))
    for ch, twin in list(pairs.items()):
        for accent in range(0x0300, 0x0370):
            whole = unicodedata.normalize("NFC", ch + chr(accent))
            if len(whole) == 1:
                pairs[whole] = unicodedata.normalize("NFC", twin + chr(accent))
    return pairs


def _translate(expr: str, pairs: dict[str, str]) -> str:
    return f"translate({expr}, {_quoted(''.join(pairs))}, {_quoted(''.join(pairs.values()))})"


def _map(expr: str, pairs: dict[str, str]) -> str:
    """``translate`` for single characters, ``replace`` for what becomes or was several."""
    for a, b in pairs.items():
        if len(a) > 1 or len(b) > 1:
            expr = f"replace({expr}, {_quoted(a)}, {_quoted(b)})"
    return _translate(expr, {a: b for a, b in pairs.items() if len(a) == len(b) == 1})


@cache
def _weighed(column: str, source: str, all_rows: bool) -> str:
    """Stages that lead from the text to its Latin form with the letters of each script counted: (n, t, c, g, l)."""
    one, more = _compatible()
    cyr, greek = _composed(CYRILLIC, CYR_LATIN), _composed(GREEK, GREEK_LATIN)
    own_cyr, own_greek = _own_letters("CYRILLIC", cyr), _own_letters("GREEK", greek)
    text = f"regexp_replace({column}, '[{_class(INVISIBLE)}]', '', 'g')"
    for ch, to in more.items():
        text = f"replace({text}, {_quoted(ch)}, {_quoted(to)})"
    done = "false" if all_rows else f"c0 = 0 AND g0 = 0 AND regexp_full_match({column}, '[\\x09\\x0A\\x0D\\x20-\\x7E]*')"
    return f"""
        WITH plain AS MATERIALIZED (
            SELECT n, {column}, c0, g0, l0, {done} AS done FROM {source}
        ), composed AS MATERIALIZED (
            SELECT n, c0, g0, l0, nfc_normalize({_translate(text, one)}) AS t FROM plain WHERE NOT done
        ), latin AS MATERIALIZED (
            SELECT n, c0, g0, l0, nfc_normalize({_map(_map("t", cyr), greek)}) AS t FROM composed
        ), weighed AS MATERIALIZED (
            SELECT n, t, c0 + length(regexp_replace(t, '[^{own_cyr}]+', '', 'g')) AS c, g0 + length(regexp_replace(t, '[^{own_greek}]+', '', 'g')) AS g,
                l0 + length(regexp_replace(t, '[^\\p{{Latin}}]+', '', 'g')) - length(regexp_replace(t, '[^{"".join(sorted(set("".join(cyr.values()) + "".join(greek.values()))))}]+', '', 'g')) AS l
            FROM latin
        )"""


def _own_letters(name: str, taken: dict[str, str]) -> str:
    """Letters of a script that no look-alike stands for, as a class."""
    return "".join(rf"\x{{{c:X}}}" for c in range(0x370, 0x530) if unicodedata.category(chr(c))[0] == "L" and unicodedata.name(chr(c), "").startswith(name) and chr(c) not in taken)


@cache
def canonical_sql(column: str = "text", source: str = "batch") -> str:
    """The embedded SQL: one row of ``source`` in, ``canonical`` out, in the same order.

    ``source`` has n, the text, and c0, g0 and l0: the letters of Cyrillic only, of Greek
    only and of Latin only that stand in other parts of the same text.
    """
    cyr, greek = _composed(CYRILLIC, CYR_LATIN), _composed(GREEK, GREEK_LATIN)
    own_cyr, own_greek = _own_letters("CYRILLIC", cyr), _own_letters("GREEK", greek)
    back = lambda pairs: {b: a for a, b in reversed(pairs.items())}
    twins = lambda pairs: "".join(sorted(set("".join(pairs.values()))))
    return f"""{_weighed(column, source, False)}, taken AS (
            SELECT n, CASE WHEN c > l AND c >= g THEN 1 WHEN g > l AND g > c THEN 2 ELSE 0 END AS most, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+[^\\p{{L}}\\p{{M}}]*|[^\\p{{L}}\\p{{M}}]+') AS ws
            FROM weighed WHERE c > 0 OR g > 0
        ), words AS (
            SELECT n, most, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM taken
        ), written AS (
            SELECT w, most, CASE WHEN regexp_matches(w, '[{own_cyr}]') THEN {_map("w", back(cyr))}
                     WHEN regexp_matches(w, '[{own_greek}]') THEN {_map("w", back(greek))}
                     WHEN most = 1 AND regexp_full_match(w, '[{twins(cyr)}]+[^\\p{{L}}\\p{{M}}]*') THEN {_map("w", back(cyr))}
                     WHEN most = 2 AND regexp_full_match(w, '[{twins(greek)}]+[^\\p{{L}}\\p{{M}}]*') THEN {_map("w", back(greek))}
                     ELSE w END AS v
            FROM (SELECT DISTINCT w, most FROM words)
        ), joined AS (
            SELECT n, string_agg(v, '' ORDER BY i) AS t FROM words JOIN written USING (w, most) GROUP BY n
        )
        SELECT CASE WHEN p.done OR p.{column} IS NULL THEN p.{column} ELSE nfc_normalize(coalesce(w.t, l.t)) END AS canonical
        FROM plain p LEFT JOIN latin l USING (n) LEFT JOIN joined w USING (n) ORDER BY p.n"""


@cache
def weights_sql(column: str = "text", source: str = "batch") -> str:
    """(c, g, l): letters of Cyrillic only, Greek only and Latin only in all rows of ``source`` together."""
    return f"{_weighed(column, source, True)} SELECT coalesce(sum(c), 0)::BIGINT AS c, coalesce(sum(g), 0)::BIGINT AS g, coalesce(sum(l), 0)::BIGINT AS l FROM weighed"


def _cut(text: str, size: int) -> list[str]:
    """Parts of a long text of at least ``size`` characters but for the last, each beginning where BREAK allows; without such places they are longer."""
    out, at = [], 0
    while m := BREAK.search(text, at + size):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def canonical_arrow(batches: Iterator[pa.RecordBatch], text: str, out: str, memory_mb: int = MEMORY_MB, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Adds ``out`` to each batch by a DuckDB of one thread and bounded memory that lives as long as the partition.

    It gets ``most`` bytes of text at a time. A longer text goes there in parts, twice: the
    first time its letters are counted, the second time each part is written with the counts
    of the others. A part that can't be cut takes more memory, in proportion to its size.
    """
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": ""}) as db:

        def run(sql: str, texts: pa.Array, others: tuple[int, int, int] = (0, 0, 0)) -> pa.Table:
            n = len(texts)
            db.sql(f"SET memory_limit = '{memory_mb + MEMORY_FACTOR * max(0, texts.nbytes - 2 * most) // (1 << 20)}MB'")
            db.register("batch", pa.table({"n": pa.array(np.arange(n)), "text": texts, **{c: pa.array(np.full(n, v, np.int64)) for c, v in zip(("c0", "g0", "l0"), others, strict=True)}}))
            done = db.sql(sql).to_arrow_table()
            db.unregister("batch")
            return done

        def long(value: str) -> str:
            parts = _cut(value, most // 4)
            counts = np.array([[x[0].as_py() for x in run(weights_sql(), pa.array([p])).columns] for p in parts])
            rest = counts.sum(0) - counts
            return "".join(run(canonical_sql(), pa.array([p]), tuple(r)).column(0)[0].as_py() for p, r in zip(parts, rest.tolist(), strict=True))

        for batch in batches:
            texts = batch.column(text).cast(pa.large_string())
            sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            done, at = [], 0
            while at < len(texts):
                if sizes[at] > most:
                    done.append(pa.array([long(texts[at].as_py())], pa.string()))
                    at += 1
                    continue
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
                done.append(run(canonical_sql(), texts.slice(at, to - at)).column("canonical").cast(pa.string()).combine_chunks())
                at = to
            flat = [c for x in done for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(flat) if flat else pa.array([], pa.string())], names=[*batch.schema.names, out])


def canonicalize(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Adds ``out``, the one form of ``text``; every row comes out once, with its columns.

    Null stays null and empty stays empty; a text of plain ASCII is its own form. Any column
    that is already called ``out`` is replaced. The result depends on the text alone, so
    repeated rows come out alike, and an empty table gives an empty table. Texts may be of
    any length and share batches with any others.
    """
    kept = df.drop(out) if out != text else df.withColumn("_text", F.col(text)).drop(text)
    at = text if out != text else "_text"
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])
    done = kept.mapInArrow(lambda batches: canonical_arrow(batches, at, out), schema)
    return done.drop("_text") if out == text else done


def same_reading(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text that isn't null: ``key``, ``class_id`` of what reads the same, ``variant`` of the stored characters.

    Classes and variants are 128-bit hashes; texts are read once and don't move.
    """
    forms = canonicalize(df.where(F.col(text).isNotNull()).select(key, text), text, "_canonical")
    return forms.select(key, F.md5("_canonical").alias("class_id"), F.md5(text).alias("variant"))
