"""Streaming ingest of documents (leak filter, normalization, chunks; each document once), progress by term, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brieflake.functions.chunking import chunks
from brieflake.functions.text import normalize_page
from brieflake.operators import filters as FL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, chunk_index, content) of documents that aren't opinions; works on streams and tables."""
    kept = docs.filter(FL.opinion_marker(FL.first_pages(F.array("text"))).isNull())
    cut = kept.select("doc_id", "source", F.posexplode(chunks(normalize_page(F.col("text")))).alias("chunk_index", "content"))
    return cut.filter(FL.longer(F.col("content"), 100))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Parquet files that arrive in `folder` as chunk rows in `out`, a partition a batch.

    A document counts once, however often and in whichever batch it is delivered (the first delivery stays): its id is
    kept in the query's state, which the checkpoint restores after a restart. A batch that is run again overwrites its own
    partition, so neither retries nor re-deliveries double a row. The state grows by an id a document: at scale set
    spark.sql.streaming.stateStore.providerClass to the RocksDB provider, which keeps it on disk.
    """
    docs = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder).dropDuplicates(["doc_id"])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunk_rows(docs).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_progress(fetched: DataFrame) -> DataFrame:
    """fetched (term, number, done: the marker that a term is complete) -> term, last (the checkpoint: resume at last + 1), done.

    On a stream it is a running aggregate: one row of state a term, the same whatever is delivered again or out of order.
    """
    return fetched.groupBy("term").agg(F.max("number").alias("last"), F.coalesce(F.bool_or("done"), F.lit(False)).alias("done"))


def follow_terms(fetched: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """term_progress() of a stream as a table in `out` (overwritten whole by each batch: a row a term)."""
    progress = term_progress(fetched)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={number}")

    return progress.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, out: str) -> DataFrame:
    """term, last, done of the newest batch."""
    every = spark.read.parquet(out)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version").drop("version")


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts and sums per type of a stream with a watermark (or of a table)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
