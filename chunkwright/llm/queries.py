"""The registered pN_ queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwright.llm import sql
from chunkwright.llm.canonical import canonicalize, same_reading
from chunkwright.llm.freq import term_frequencies
from chunkwright.llm.knn import HALF_ERROR, K, nearest, similar_pairs
from chunkwright.llm.lines import frequent_lines, prefix_span, repeated_lines, without_repeated_lines
from chunkwright.llm.mixing import mix, mix_report, mixed_tokens
from chunkwright.llm.neardup import NearDuplicates
from chunkwright.llm.packing import containers, pack, packed_texts
from chunkwright.llm.pairs import class_pairs
from chunkwright.llm.split import split_chunks, split_oversized
from chunkwright.llm.terms import log_entropy
from chunkwright.operators.dense import dense_top_k
from chunkwright.operators.skew import with_key_totals
from chunkwright.session import checkpointed

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_oversized(_table(spark, folder, "chunks").select("chunk_no", "text"))
    return pieces.where("piece_total > 1 AND piece_index = 0").select("chunk_no")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = split_chunks(_table(spark, folder, "chunks").select("chunk_no", "text", "source_document", "section_path", "chunk_index"))
    return pieces.select("chunk_no", "source_document", "section_path", "chunk_index", "chunk_total", "piece_index", "piece_total", "added_start", "text")


def p1_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of each row, whether its pieces are within the limit and numbered through, share what they should, and give its text again without what they share."""
    chunks = _table(spark, folder, "chunks").select("chunk_no", "text")
    pieces = split_oversized(chunks.where("text IS NOT NULL"))
    after = Window.partitionBy("chunk_no").orderBy("piece_index")
    shared = F.octet_length(F.expr("substring(text, 1, added_start - piece_start)"))
    marked = pieces.select("chunk_no", "piece_index", "piece_total", F.octet_length("text").alias("_size"), shared.alias("_shared"), F.row_number().over(after).alias("_n"), F.expr("substring(text, added_start - piece_start + 1)").alias("_added"))
    fits = (F.col("_size") <= 1600) & (F.col("_n") == F.col("piece_index") + 1) & F.when(F.col("piece_index") == 0, F.col("_shared") == 0).otherwise(F.col("_shared").between(200, 203))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_index", "_added"))), lambda p: p["_added"]), "")
    whole = marked.groupBy("chunk_no").agg(F.bool_and(fits).alias("fits"), (F.count("*") == F.max("piece_total")).alias("numbered"), joined.alias("_joined"))
    return chunks.join(whole, "chunk_no").select("chunk_no", F.octet_length("text").cast("bigint").alias("n_bytes"), "fits", "numbered", (F.col("_joined") == F.col("text")).alias("whole"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = log_entropy(_table(spark, folder, "chunks").select("chunk_no", "text"))
    return scored.where("tf >= 4 AND df BETWEEN 2 AND 12 AND score IS NOT NULL").select("chunk_no", "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = log_entropy(_table(spark, folder, "chunks").select("chunk_no", "text"))
    return scored.select("chunk_no", "term", "tf", "df", F.round("score", 6).alias("score"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = similar_pairs(_table(spark, folder, "chunks").select("chunk_no", "embedding"), 0.9)
    return pairs.select(F.col("a").alias("chunk_no_a"), F.col("b").alias("chunk_no_b"))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = nearest(_table(spark, folder, "chunks").select("chunk_no", "embedding"))
    return near.select(F.col("key").alias("chunk_no"), F.col("neighbour").alias("neighbour_no"), F.round("cosine", 3).alias("cosine"), "rank")


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One row: the searches whose id is divisible by 100, and whether nine tenths of their neighbours by brute force are as good as found."""
    chunks = _table(spark, folder, "chunks").select("chunk_no", "embedding")
    asked = chunks.where("chunk_no % 100 = 0").select(F.col("chunk_no").alias("query_id"), F.col("embedding").alias("vec"))
    exact = dense_top_k(chunks, asked, "chunk_no", K + 1).where("query_id != chunk_no").withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("_n") <= K)
    least = checkpointed(exact.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_wanted")))
    found = nearest(chunks).where("key % 100 = 0").join(least, F.col("key") == F.col("query_id")).where(F.col("cosine") >= F.col("_least") - HALF_ERROR)
    hits = checkpointed(found.groupBy("query_id").agg(F.least(F.count("*"), F.first("_wanted")).alias("_hits")))
    return least.join(hits, "query_id", "left").agg(F.count("*").alias("queries"), (F.sum(F.coalesce("_hits", F.lit(0))) >= 0.9 * F.sum("_wanted")).alias("enough"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = NearDuplicates(_table(spark, folder, "chunks").select("chunk_no", "text")).pairs()
    return found.select(F.col("a").alias("chunk_no_a"), F.col("b").alias("chunk_no_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = NearDuplicates(_table(spark, folder, "chunks").select("chunk_no", "text")).groups()
    return groups.select(F.col("key").alias("chunk_no"), F.col("group_key").alias("group_no"), "links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequencies(_table(spark, folder, "chunks").select("chunk_no", "text")).where("mark != 'useful'").select("term")


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequencies(_table(spark, folder, "chunks").select("chunk_no", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    lines = repeated_lines(_table(spark, folder, "chunks").select("chunk_no", "text", "source_document"))
    return lines.select("chunk_no", F.col("line_no").cast("bigint").alias("line_no"))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeated_lines(_table(spark, folder, "chunks").select("chunk_no", "text", "source_document")).select("chunk_no", "text", "lines_removed")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents").select("doc_id", "text")).where("piece_total > 1 AND piece_index = 0").select("doc_id")


def p6_sequences(spark: SparkSession, folder: str) -> DataFrame:
    spans = prefix_span(checkpointed(frequent_lines(_table(spark, folder, "chunks").select("chunk_no", "text", "source_document"))))
    first = F.array_join(F.min_by("at", "chunk_no"), " ")
    return spans.groupBy("pattern").agg(F.size(F.first("pattern")).alias("length"), F.count("*").alias("rows"), F.min("chunk_no").alias("first_chunk_no"), first.alias("first_lines")).drop("pattern")


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return packed_texts(pack(documents), documents)


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers(pack(_table(spark, folder, "documents").select("doc_id", "text")))


def p7_fit(spark: SparkSession, folder: str) -> DataFrame:
    """One row about the packing: what is packed, containers beyond their capacity, and whether all of them hold 98 % of their room but for one container a shard."""
    packed = checkpointed(pack(_table(spark, folder, "documents").select("doc_id", "text")))
    filled = checkpointed(containers(packed).agg(F.count_if(F.col("left_empty") < 0).alias("overfull"), F.count("*").alias("n"), F.countDistinct(F.shiftright("container", 32)).alias("shards")))
    held = packed.agg(F.countDistinct("doc_id").alias("documents"), F.sum("size").cast("bigint").alias("tokens"), F.countDistinct(F.when(F.col("piece_total") > 1, F.col("doc_id"))).alias("split"))
    tight = (filled.select("n").scalar() - filled.select("shards").scalar()) * 8192 * 0.98 <= F.col("tokens")
    return held.select("documents", "tokens", "split", filled.select("overfull").scalar().alias("overfull"), tight.alias("tight"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_shares(spark, folder).where("short").select("source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(_table(spark, folder, "documents").select("doc_id", "text", "source"), _table(spark, folder, "mix_targets"))


def p8_reached(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the mixture holds each source's share, or all that it may give where that is less, to two blocks."""
    reached = p8_shares(spark, folder)
    total = _table(spark, folder, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).scalar()
    wanted = F.least(F.ceil(F.col("target_permille") * total / 1000).cast("bigint"), F.col("source_size") * F.col("max_repeats"))
    return reached.select("source", "source_size", wanted.alias("wanted_size"), "short", (F.col("reached_size") - wanted).between(0, 2048).alias("held"))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text", "source")
    mixed, _ = mix(documents, _table(spark, folder, "mix_targets"))
    return mixed_tokens(mixed, documents)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    classes = same_reading(_table(spark, folder, "documents"))
    return class_pairs(classes, "doc_id", differ="variant")


def p9_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonicalize(_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "canonical")


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the first of those that read the same, and the characters of its form."""
    forms = checkpointed(canonicalize(_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.md5("canonical").alias("_c"), F.length("canonical").cast("bigint").alias("n_chars")))
    sized = with_key_totals(forms, ["_c"], "doc_id", {"n_rows": F.lit(1)})
    firsts = forms.groupBy("_c").agg(F.min("doc_id").alias("first_doc_id"))
    return sized.join(firsts, "_c").select("doc_id", "first_doc_id", "n_rows", "n_chars")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("p") and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
