"""Incremental ingest of new caption or text files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorekeep.operators.chunking import ChunkConfig, chunk_documents
from lorekeep.operators.retrieve import Embedder, HashingEmbedder
from lorekeep.sources.store import TopicStore


def ingest_documents(spark: SparkSession, source: str, store: TopicStore, topic: str, checkpoint: str, embedder: Embedder | None = None, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Chunks, embeds and stores the Parquet files of a folder that were not seen before, then stops.

    Batch numbers order the writes, counted from the store's last one: a batch
    that runs again after a failure supersedes itself instead of adding rows,
    and a new checkpoint never loses against older writes.
    """
    base = store.last_seq() + 1
    embedder = embedder or HashingEmbedder()
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk_documents(batch, config=config)
        vectors = embedder.embed(chunks.select("chunk_id", "text"), "text").select("chunk_id", "embedding")
        store.ingest(topic, chunks, vectors, base + number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_scores(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Event counts and means by hour and type, for a stream or a table; late rows beyond the delay are dropped from a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("hour"), "event_type", "n", "mean_value")
