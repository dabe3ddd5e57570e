"""Metadata tables: one extraction per file, and their join to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_extractions(metadata: DataFrame) -> DataFrame:
    """One row per file, letter case aside: the latest extraction, lost years taken from another.

    An aggregation with partial maxima, so a file extracted very often is no single task.
    """
    fields = ("title", "authors", "detected_language", "page_count", "has_toc", "file_size")
    key = F.lower("source_file").alias("file_key")
    order = F.struct("extracted_at", F.coalesce("title", F.lit("")), F.coalesce("file_size", F.lit(-1)))
    return metadata.where("source_file is not null").groupBy(key).agg(
        *(F.max_by(f, order).alias(f) for f in fields),
        F.max_by("year", F.when(F.col("year").isNotNull(), F.struct("extracted_at", "year"))).alias("year"),
        F.count("*").alias("extractions"),
        F.max("extracted_at").alias("extracted_at"),
    )


def attach_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every chunk with the metadata of its file, nulls where there is none."""
    files = latest_extractions(metadata).select("file_key", *(F.col(c).alias(f"file_{c}") for c in ("title", "year", "authors", "detected_language", "page_count")))
    return chunks.withColumn("file_key", F.lower("source_file")).join(files, "file_key", "left").drop("file_key")


def contents_entries(metadata: DataFrame) -> DataFrame:
    """One row per contents entry, with its place."""
    entry = F.posexplode("toc").alias("place", "entry")
    return metadata.select("source_file", "extracted_at", entry).select("source_file", "extracted_at", "place", "entry.level", "entry.title", "entry.page").where("entry is not null")
