"""Reranking: scores by a pluggable model, thresholds, fallbacks, ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwright.functions.text import fence_stripped, terms
from chunkwright.functions.vector import sigmoid
from chunkwright.operators.chunking import Tokenizer, leading, piece_tokenizer

#: Scores (query, text) pairs with logits; called with a batch at a time, loaded once in each worker.
CrossEncoder = Callable[[Sequence[str], Sequence[str]], Sequence[float]]

#: Answers a prompt, given a system prompt; called once for each query.
Judge = Callable[[str, str], str]

LOWEST = 5.0
JUDGE_SYSTEM = """You score how relevant pieces of documents are to a question. Answer with a JSON array only, one entry for each piece, in their order: [{"id": 0, "score": 0}, ...].
A score is a number from 0 to 10: up to 2 if a piece has nothing to do with the question, up to 4 if it touches the subject, up to 6 if it answers in part, up to 8 if it answers well, up to 10 if it answers in full.
Judge the meaning, not shared words."""
LLM_SCORES = "array<struct<id:int,score:double>>"


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a model: ten times the share of the query's different terms that the text has; 0 without terms."""
    asked = F.array_distinct(terms(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(F.coalesce(text, F.lit(""))))) * 10.0 / F.size(asked)).otherwise(0.0)


def truncated(text: str, limit: int, tokenizer: Tokenizer) -> str:
    """The first ``limit`` tokens of a text."""
    ends = leading(text, limit, tokenizer)
    return text if len(ends) <= limit else text[: ends[limit - 1]]


def model_score(query: Column, text: Column, load: Callable[[], CrossEncoder], limit: int = 512, tokenizer: Tokenizer = piece_tokenizer) -> Column:
    """Ten times the sigmoid of a cross-encoder's logit, of the first ``limit`` tokens of each text. ``load`` is called once in each Python worker; a model's failure fails the query; null texts are empty."""

    @F.pandas_udf("double")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            short = [truncated(t, limit, tokenizer) for t in texts.fillna("")]
            yield pd.Series(list(model(queries.fillna("").tolist(), short)), dtype="float64")

    return sigmoid(logits(query, text)) * 10


def ranked(scored: DataFrame, by: str = "query_id", score: str = "relevance_score", original: str = "original_rank") -> DataFrame:
    """Adds ``new_rank`` over all rows of each ``by``: larger scores first, NaN and null last, ties in the original order."""
    value = F.coalesce(F.nanvl(F.col(score), F.lit(float("-inf"))), F.lit(float("-inf")))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy(by).orderBy(value.desc(), F.asc(original))))


def rerank(candidates: DataFrame, k: int, score: Column, by: str = "query_id", original: str = "original_rank") -> DataFrame:
    """The ``k`` best of each ``by`` by ``score``, ranks numbered over the full list before the cut."""
    return ranked(candidates.withColumn("relevance_score", score), by, original=original).where(F.col("new_rank") <= k)


def rerank_above(scored: DataFrame, k: int, lowest: float = LOWEST, by: str = "query_id") -> DataFrame:
    """The ``k`` best of each ``by`` with a score of ``lowest`` at least, ranks numbered after the cut; null and NaN never are."""
    enough = (F.col("relevance_score") >= lowest) & ~F.isnan("relevance_score")  # NaN is larger than any number
    return ranked(scored.where(enough), by).where(F.col("new_rank") <= k)


def fallback(candidates: DataFrame, k: int, original: str = "original_rank") -> DataFrame:
    """What comes out when a judge fails: the first ``k`` as they were, at scores of 5.0, 4.9 and so on."""
    first = candidates.where(F.col(original) <= k)
    return first.withColumn("relevance_score", F.round(F.lit(LOWEST) - (F.col(original) - 1) * 0.1, 6)).withColumn("new_rank", F.col(original))


def judged_scores(content: Column, expected: Column, by_id: bool = False) -> Column:
    """Scores out of a judge's answer, an array by position (by the answer's own ids from 0 on with ``by_id``).

    The answer is a JSON array of {id, score}, fenced or not. One that can't be read or has
    another length gives 5.0 for every text.
    """
    read = F.from_json(fence_stripped(content), LLM_SCORES)
    fits = read.isNotNull() & (F.size(read) == expected) & ~F.exists(read, lambda x: x["score"].isNull())
    positional = F.transform(read, lambda x: x["score"])
    if by_id:
        positional = F.transform(F.array_sort(read), lambda x: x["score"])
    return F.coalesce(F.when(fits, positional), F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda _: F.lit(LOWEST)))


def judge_prompt(texts: DataFrame, by: str = "query_id", text: str = "text", original: str = "original_rank", query: str = "query") -> DataFrame:
    """(by, n, prompt): the query and the texts of each ``by`` as one prompt, the texts numbered from 0 in their order. ``text`` should hold the chunks under their headers."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct(original, text))), lambda x, i: F.concat(F.lit("Chunk: "), i.cast("string"), F.lit("\n"), F.coalesce(x[text], F.lit(""))))
    asked = F.coalesce(F.first(query, ignorenulls=True), F.lit(""))
    n = F.count(F.lit(1)).cast("int")
    prompt = F.concat(F.lit("Query: "), asked, F.lit("\n\nChunks to score:\n\n"), F.array_join(entries, "\n\n"), F.lit("\n\nGive a JSON array with the scores of all "), n.cast("string"), F.lit(" chunks."))
    return texts.groupBy(by).agg(n.alias("n"), prompt.alias("prompt"))


def judge_answers(prompts: DataFrame, load: Callable[[], Judge], by: str = "query_id") -> DataFrame:
    """(by, content): a judge's answer to each prompt. ``load`` is called once in each Python worker; a prompt on which the judge fails has a null answer."""

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(prompt: str) -> str | None:
            try:
                return model(JUDGE_SYSTEM, prompt)
            except Exception:  # noqa: BLE001
                return None

        for prompts in batches:
            yield prompts.map(one).astype(object)

    return prompts.select(by, answers(F.col("prompt")).alias("content"))


def judge(candidates: DataFrame, k: int, answers: DataFrame, lowest: float = LOWEST, by: str = "query_id") -> DataFrame:
    """Reranks by a judge's answers (by, content): parsed scores by position, the threshold, and for a query without an answer the fallback."""
    sized = candidates.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    candidates = candidates.drop("relevance_score", "new_rank")
    scores = sized.join(answers.select(by, "content"), by, "left").select(by, F.col("content").isNotNull().alias("_answered"), judged_scores(F.col("content"), F.col("_n")).alias("_scores"))
    joined = candidates.join(scores, by)
    scored = joined.where("_answered").withColumn("relevance_score", F.try_element_at("_scores", F.col("original_rank").cast("int"))).drop("_answered", "_scores")
    return rerank_above(scored, k, lowest, by).unionByName(fallback(joined.where("NOT _answered").drop("_answered", "_scores"), k))
