"""Incremental ingest with Structured Streaming: a batch of new documents replaces what the store has of them.

Ids are content hashes and every write replaces by document, so a batch that is run again changes nothing. The store is
partitioned Parquet; only the partitions of the batch's documents are rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.chunking import chunk_pages, page_offsets

#: Buckets of a store; choose some one per 256 MB that the table will hold, as a batch rewrites the buckets of its documents.
BUCKETS = 64


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def _finish(spark: SparkSession, path: str, schema) -> None:
    """Puts what is staged in place, if it is whole, and removes it; run again after a crash it does the same once more.

    A batch is staged first and marked whole by its ``_SUCCESS`` file, so a crash while it is put in place loses nothing: the
    next batch finds it and finishes. What is staged without the mark was never promised and is dropped.
    """
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path}__staged")
    files = staged.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}__staged/_SUCCESS")):
        rows = spark.read.schema(schema).parquet(f"{path}__staged")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    files.delete(staged, True)


def store_by_document(spark: SparkSession, new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the documents of ``new`` in the table at ``path``, touching only their buckets."""
    rows = _bucketed(new, buckets)
    _finish(spark, path, rows.schema)
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
    try:
        old = spark.read.schema(rows.schema).parquet(path).filter(F.col("bucket").isin(touched))
        kept = old.join(rows.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = kept.select(*rows.columns).unionByName(rows)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}__staged")
    _finish(spark, path, rows.schema)


def ingest_batch(pages: DataFrame, store: str, buckets: int = BUCKETS) -> None:
    """Pages (``doc_id, page_index, text``) to offsets and chunks, written below ``store``."""
    spark = pages.sparkSession
    rows = pages.dropDuplicates(["doc_id", "page_index"])
    placed = rows.drop("char_start", "char_end").join(page_offsets(rows), ["doc_id", "page_index"])
    store_by_document(spark, placed, f"{store}/pages", buckets)
    written = spark.read.parquet(f"{store}/pages").join(rows.select("doc_id").distinct(), "doc_id", "left_semi").drop("bucket")
    store_by_document(spark, chunk_pages(written), f"{store}/chunks", buckets)


def stream_ingest(pages: DataFrame, store: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs ``ingest_batch`` on every micro-batch of a streaming frame of pages, until no file is left."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        ingest_batch(batch, store)
        if each:
            each(batch, number)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs an aggregation over all files at hand; each micro-batch rewrites its result at ``path``, which is read back."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


def deduplicated(stream: DataFrame, time_col: str = "ingested_at", delay: str = "1 day") -> DataFrame:
    """An extension: rows of a document seen before within the watermark are dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["doc_id"])


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by window and key, late ones within ``delay`` included."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("n"))
