"""Stop-word lists, their algebra, and filtering by them."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"en": "english", "de": "german", "fr": "french", "es": "spanish"}

# Words that the extended English list has besides Spark's.
EXTENDED = "actually already also although always anyway became become certainly clearly currently example especially finally generally however important indeed instead likely many maybe might much must often perhaps possible probably quite rather really several simply since specific still thus together usually various well whether within without yet".split()


def words(language: str | None) -> list[str]:
    """The list of a language: en, en-extended, de, fr, es, or none for None. Needs a session."""
    if language is None:
        return []
    if language == "en-extended":
        return combined(words("en"), EXTENDED)
    if language not in LANGUAGES:
        raise ValueError(f"no stop words for {language}")
    return list(dict.fromkeys(StopWordsRemover.loadDefaultStopWords(LANGUAGES[language])))


def combined(*lists: list[str]) -> list[str]:
    """Every different word of the lists, in the order they first come."""
    return list(dict.fromkeys(w for words_in in lists for w in words_in))


def extended(base: list[str], *more: str) -> list[str]:
    return combined(base, list(more))


def excluded(base: list[str], *gone: str) -> list[str]:
    """The list without some words, in any case."""
    out = {w.lower() for w in gone}
    return [w for w in base if w.lower() not in out]


def from_file(spark: SparkSession, path: str) -> list[str]:
    """Words of a text file, one a line, trimmed; blank lines and those that begin with # don't count. A missing file has none."""
    if "://" not in path and not Path(path).exists():
        return []
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("w")).where("w != '' AND NOT startswith(w, '#')")
    return [r["w"] for r in lines.collect()]


def stop_word_table(spark: SparkSession) -> DataFrame:
    """(lang, word) of every language."""
    return spark.createDataFrame([(code, w) for code in LANGUAGES for w in words(code)], "lang string, word string")


def without_stop_words(term_rows: DataFrame, language: str = "lang", term: str = "term") -> DataFrame:
    """Rows whose term isn't a stop word of their language: an anti-join with the lists, which are a few hundred words and broadcast."""
    table = stop_word_table(term_rows.sparkSession).withColumnsRenamed({"lang": "_lang", "word": "_word"})
    return term_rows.join(F.broadcast(table), (F.col(language) == F.col("_lang")) & (F.col(term) == F.col("_word")), "left_anti")
