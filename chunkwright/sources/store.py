"""The chunk index: Parquet partitioned by batch and document, with upsert, append, delete and clear.

Each change writes one new batch, and with it the postings and totals of its chunks; a
manifest tells which batches hold which documents, and a pointer file names the current
manifest and is replaced last, by one rename. So a change rewrites only documents that lose
single chunks, readers see all of it or nothing, and a lost executor or driver leaves the old
index in place. What the manifest before names stays until the next change, for readers that
still hold it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwright.functions.text import BETWEEN_TERMS
from chunkwright.operators.bm25 import TextPostings, corpus_stats, document_weights, merged_stats, statistics_of, term_frequencies, term_stats
from chunkwright.schema import CHUNK
from chunkwright.session import checkpointed

#: So many batches at most are named in the scan's filter.
MOST_BATCHES = 1000


def upserted(old: DataFrame, new: DataFrame, key: str = "id", order: str = "_ord") -> DataFrame:
    """``old`` without the keys of ``new``, and the last row of each key of ``new`` by ``order``. Null keys are kept as they are."""
    last = new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    fresh = last.unionByName(new.where(F.col(key).isNull()).drop(order))
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").unionByName(fresh)


def to_payload(chunks: DataFrame) -> DataFrame:
    """Chunks as points of a vector database: id, vector and a payload in camel case, the metadata as JSON text."""
    return chunks.select(
        F.col("id"), F.col("embedding").alias("vector"),
        F.struct(
            F.col("id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source_document").alias("sourceDocument"), F.col("start_page").alias("startPage"), F.col("end_page").alias("endPage"),
            F.col("chunk_index").alias("chunkIndex"), F.col("chunk_total").alias("chunkTotal"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("section_path", F.lit("")).alias("sectionPath"), F.to_json("metadata").alias("metadata"),
        ).alias("payload"),
    )


def from_payload(points: DataFrame) -> DataFrame:
    """Chunks of points, without their vectors; missing or unreadable metadata is an empty map."""
    p = F.col("payload")
    empty = F.create_map().cast("map<string,string>")
    return points.select(
        p["id"].alias("id"), p["text"].alias("text"), p["sourceDocument"].alias("source_document"), p["startPage"].alias("start_page"), p["endPage"].alias("end_page"), p["chunkIndex"].alias("chunk_index"),
        p["chunkTotal"].alias("chunk_total"), p["section"].alias("section"), p["sectionPath"].alias("section_path"), F.coalesce(F.from_json(p["metadata"], "map<string,string>"), empty).alias("metadata"),
    )


POSTING = T.StructType([T.StructField("id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("length", T.LongType()), T.StructField("weight", T.DoubleType())])
TOTALS = T.StructType([T.StructField("docs", T.LongType()), T.StructField("length", T.LongType())])


class ChunkStore:
    """An index in a folder that all executors reach. With ``frozen``, postings keep the full BM25 weight that they had among all chunks when they were written."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = CHUNK, partition: str = "source_document", frozen: bool = False):
        self.spark, self.path, self.schema, self.partition, self.frozen = spark, path.rstrip("/"), schema, partition, frozen
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._path = hadoop.Path
        self._manifest_schema = T.StructType([schema[partition], T.StructField("batch", T.StringType())])

    def _pointer(self):  # noqa: ANN202
        return self._path(f"{self.path}/current")

    def version(self) -> str | None:
        """The name of the current manifest, if there is one."""
        if not self._fs.exists(self._pointer()):
            return None
        return self.spark.read.text(f"{self.path}/current").first()[0]

    def create(self) -> None:
        """An empty index, unless there is one."""
        if self.version() is None:
            self._publish(None)

    def manifest(self, version: str | None = None) -> DataFrame:
        """(document, batch): where the chunks of each document lie."""
        version = version or self.version()
        if version is None:
            return self.spark.createDataFrame([], self._manifest_schema)
        return self.spark.read.schema(self._manifest_schema).parquet(f"{self.path}/{version}")

    def _same(self, a: DataFrame, b: DataFrame):  # noqa: ANN202
        return a[self.partition].eqNullSafe(b[self.partition])

    def _live(self, folder: str, schema: T.StructType, more: str | None = None) -> DataFrame:
        """The rows of a folder that the manifest names (or those of the batch ``more``), with document and batch."""
        whole = T.StructType([f for f in schema if f.name != self.partition] + [T.StructField("batch", T.StringType()), self.schema[self.partition]])
        if not self._fs.exists(self._path(f"{self.path}/{folder}")):
            return self.spark.createDataFrame([], whole)
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}")
        if more is not None:
            return rows.where(F.col("batch") == more)
        manifest = self.manifest()
        batches = [r["batch"] for r in manifest.select("batch").distinct().limit(MOST_BATCHES + 1).collect()]
        if len(batches) <= MOST_BATCHES:
            rows = rows.where(F.col("batch").isin(batches))  # folders of other batches aren't listed
        return rows.join(manifest, self._same(rows, manifest) & (rows["batch"] == manifest["batch"]), "left_semi")

    def load(self) -> DataFrame:
        """All chunks; none if there is no index."""
        return self._live("data", self.schema).select(*[f.name for f in self.schema])

    def _write(self, rows: DataFrame, folder: str, batch: str) -> None:
        # the hint lets Spark split large documents and put small ones together
        rows.hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/{folder}/batch={batch}")

    def _publish(self, rows: DataFrame | None, touched: DataFrame | None = None, anew: bool = False) -> None:
        """Writes ``rows`` as a batch and a manifest of it and of what there was, without the documents ``touched``, or without all with ``anew``."""
        name, old = f"m-{uuid.uuid4().hex}", self.version()
        manifest = self.manifest().limit(0) if anew else self.manifest()
        if touched is not None:
            manifest = manifest.join(touched, self._same(manifest, touched), "left_anti")
        if rows is not None:
            batch = uuid.uuid4().hex
            self._write(rows.select(*[f.name for f in self.schema]), "data", batch)
            written = self._live("data", self.schema, batch)
            self._index(written, batch, touched, anew)
            manifest = manifest.unionByName(written.select(self.partition, "batch").distinct())
        manifest.write.parquet(f"{self.path}/{name}")
        draft = self._path(f"{self.path}/current-{name}")
        out = self._fs.create(draft, True)
        out.write(bytearray(name.encode()))
        out.close()
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._pointer()), options)
        self._clean({name, old} - {None})

    def _index(self, written: DataFrame, batch: str, touched: DataFrame | None, anew: bool) -> None:
        """Writes the postings of a batch's chunks, sorted by term, and the totals of its documents."""
        words = F.filter(F.split(F.lower("text"), BETWEEN_TERMS), lambda t: t != "")
        texts = written.where("id IS NOT NULL AND text IS NOT NULL").select("id", self.partition, words.alias("_w")).where(F.size("_w") > 0)
        counted = texts.select("id", self.partition, F.size("_w").cast("bigint").alias("length"), F.explode("_w").alias("term")).groupBy("id", self.partition, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        totals = texts.groupBy(self.partition).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("_w")).cast("bigint").alias("length"))
        self._write(totals, "totals", batch)
        if not self.frozen:
            weighed = counted.withColumn("weight", F.lit(None).cast("double"))
        else:
            earlier, sums = self._live("postings", POSTING), self._live("totals", TOTALS)
            if touched is not None:
                earlier, sums = (x.join(touched, self._same(x, touched), "left_anti") for x in (earlier, sums))
            if anew:
                earlier, sums = earlier.limit(0), sums.limit(0)
            corpus = checkpointed(sums.select("docs", "length").unionByName(totals.select("docs", "length")).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.sum("length") / F.sum("docs"), F.lit(1.0)).alias("average_len")))
            stats = merged_stats(term_stats(counted), term_stats(earlier.join(counted.select("term").distinct(), "term", "left_semi")))
            known = document_weights(counted.select(F.struct("id", self.partition, "tf", "length").alias("_of"), "term", "tf", "length"), stats, corpus, "_of")
            weighed = known.select("_of.*", "term", "weight")
        weighed.hint("rebalance", self.partition).sortWithinPartitions("term").select(*[f.name for f in POSTING], self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/postings/batch={batch}")

    def _clean(self, kept: set[str]) -> None:
        """Removes manifests but those ``kept``, and batches that none of them names."""
        batches = {r["batch"] for name in kept for r in self.manifest(name).select("batch").distinct().collect()}
        for status in self._fs.listStatus(self._root):
            folder = status.getPath().getName()
            if folder.startswith("m-") and folder not in kept:
                self._fs.delete(status.getPath(), True)
        for folder in ("data", "postings", "totals"):
            if self._fs.exists(self._path(f"{self.path}/{folder}")):
                for status in self._fs.listStatus(self._path(f"{self.path}/{folder}")):
                    if status.getPath().getName().removeprefix("batch=") not in batches:
                        self._fs.delete(status.getPath(), True)

    def append(self, chunks: DataFrame) -> None:
        """Adds rows under new ids, as an index does that never replaces; an empty batch changes nothing."""
        fresh = chunks.withColumn("id", F.expr("uuid()"))
        if not fresh.isEmpty():
            self._publish(fresh)

    def upsert(self, chunks: DataFrame, order: str | None = None) -> None:
        """Replaces chunks of the same id and adds the others; of several with one id in the batch, the last by ``order`` (else by place, where that is known). Only documents that held one of the ids are written again."""
        ordered = chunks.withColumn("_ord", F.col(order) if order else F.monotonically_increasing_id())
        ordered = checkpointed(ordered.select(*[f.name for f in self.schema], "_ord"))
        if ordered.isEmpty():
            return
        live = self.load()
        touched = checkpointed(live.select("id", self.partition).join(ordered.select("id").distinct(), "id", "left_semi").select(self.partition).distinct())
        self._publish(upserted(live.join(touched, self._same(live, touched), "left_semi"), ordered), touched)

    def replace(self, chunks: DataFrame) -> int:
        """Replaces all chunks of every document in the batch by its chunks there; gives their number. Made once: the batch is checkpointed."""
        made = checkpointed(chunks.select(*[f.name for f in self.schema]))
        n = made.count()
        if n:
            self._publish(made, made.select(self.partition).distinct())
        return n

    def delete_document(self, name: str) -> None:
        """Takes out all chunks of a document, which only changes the manifest. Statistics are of live chunks, so they follow."""
        self._publish(None, self.spark.createDataFrame([(name,)], T.StructType([self.schema[self.partition]])))

    def clear(self) -> None:
        self._publish(None, anew=True)

    def compact(self) -> None:
        """Writes all chunks as one batch, after many small changes."""
        self._publish(self.load(), anew=True)

    def postings(self) -> StoredPostings:
        """The stored postings of all chunks, for ``bm25_top_k``."""
        return StoredPostings(self)

    def save_stats(self) -> None:
        """Writes term_stats and corpus_stats of the live chunks beside the index."""
        live = self.load()
        term_stats(term_frequencies(live, "id")).write.mode("overwrite").parquet(f"{self.path}/term_stats")
        corpus_stats(live, "id").select("total_docs", "total_len").write.mode("overwrite").parquet(f"{self.path}/corpus_stats")

    def load_stats(self) -> tuple[DataFrame, DataFrame] | None:
        """What ``save_stats`` wrote; None if it never did."""
        if not self._fs.exists(self._path(f"{self.path}/term_stats")):
            return None
        return self.spark.read.parquet(f"{self.path}/term_stats"), self.spark.read.parquet(f"{self.path}/corpus_stats")

    def export_json(self, path: str) -> None:
        self.load().write.mode("overwrite").json(path)

    def import_json(self, path: str) -> None:
        self.upsert(self.spark.read.schema(self.schema).json(path))


class StoredPostings(TextPostings):
    """Postings as they were written with the chunks: a search reads those of its terms and no text. With a ``frozen`` store, chunks are weighed as they were when they were written."""

    def __init__(self, store: ChunkStore):
        self.key_type, self.frozen = T.StringType(), store.frozen
        self.rows = store._live("postings", POSTING)
        self.totals = store._live("totals", TOTALS)

    def postings(self, wanted: DataFrame) -> DataFrame:
        found = self.rows.join(F.broadcast(wanted), "term")
        columns = ["id", F.col("id").alias("key"), "no", "tf", "length", *(["weight"] if self.frozen else [])]
        return found.select(*columns).repartition("id").sortWithinPartitions("id")

    def statistics(self, wanted: DataFrame) -> tuple[dict[str, int], int, float]:
        each = self.rows.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("sum"))
        whole = self.totals.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("sum")).select(F.lit(None).cast("string").alias("term"), "n", "sum")
        return statistics_of(each.unionByName(whole))
