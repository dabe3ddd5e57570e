"""Structured Streaming versions: cleaning and chunking of new documents, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftloom.functions.text import clean_text
from driftloom.operators.chunking import static_chunks


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def chunk_documents(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 384) -> DataFrame:
    """Cleaned chunks of every document: stateless, so the same for batch and stream."""
    chunks = F.posexplode(static_chunks(clean_text(F.col(text)), size)).alias("chunk_no", "text")
    return documents.select(doc_id, chunks)


def first_seen(events: DataFrame, key: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Repeated keys dropped as long as their first row is within the lateness."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time; rows later than the watermark are left out."""
    grouped = events.withWatermark(time, lateness).groupBy(F.window(time, window).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), key, "n", "total")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and stops; each row is written exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
