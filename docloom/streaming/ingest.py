"""Chunk ingestion and event windows with Structured Streaming. Extras: the batch operators don't need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """New parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(path)


def first_arrivals(chunks: DataFrame, id_col: str = "chunk_id", time_col: str = "ingested_at", lateness: str = "1 day") -> DataFrame:
    """Each id once; the state forgets an id when the watermark has passed it."""
    if chunks.schema[time_col].dataType.typeName() == "timestamp_ntz":
        chunks = chunks.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return chunks.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark([id_col])


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there and stops; started again with the same checkpoint it goes on where it ended."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes", time_col: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(time_col, lateness)
    grouped = events.groupBy(F.window(time_col, width).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), kind, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", time_col: str = "ts", user: str = "user_id") -> DataFrame:
    grouped = events.groupBy(user, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
