"""Mixing sources to target weights (problem 7).

Systematic sampling: every document of a source expects ``rate`` copies, ``rate`` being the
source's target tokens over its tokens, at most its ``max_repeats``.  The expected copies are
prefix-summed over the source, one random offset is added, and a document is emitted once for each
integer boundary its interval crosses.  So a source yields its expected number of copies to within
one, no document more than ``ceil(rate)`` times, and - because documents lie in order of size class
- nearly its expected number of tokens.

Scale: a source may hold a third of all documents, so no window spans a source.  Documents are
grouped into buckets (source, size class, hash); prefix sums are taken over the bucket totals,
whose number is bounded, and inside each bucket over at most ``bucket_rows`` rows or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftloom.llm.tokens import DEFAULT_TOKENIZER, with_token_counts
from driftloom.plans.lineage import cut


def _offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for each source, the same in every run with this seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), source)), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def sized_documents(documents: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)``, written once: totals and selection both read it."""
    renamed = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return cut(with_token_counts(renamed, ["doc_id", "source"], "text", tokenizer))


def mixing_rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """For each target source its tokens, documents, wanted tokens and expected copies of a document.

    ``total_tokens``: size of the mix; by default the size of all documents of the sources with a
    positive share.  A source too small for its share at ``max_repeats`` copies is used in full,
    and the rest keeps its own target; nothing is topped up from other sources.
    """
    # a source named twice: its shares add up, the larger cap holds; negative and null count as 0
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).cast("int").alias("max_repeats"),
    )
    have = sized.where("source is not null and n_tokens > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    both = wanted.join(have, "source", "left").fillna(0, ["documents", "tokens"])
    if total_tokens is None:
        sums = both.where("target_share > 0").agg(F.sum("tokens").alias("total"))
        both = both.crossJoin(sums).fillna(0, ["total"])  # one row
    else:
        both = both.withColumn("total", F.lit(int(total_tokens)).cast("bigint"))
    return both.withColumn("target_tokens", F.col("target_share") * F.col("total")).withColumn(
        "rate", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_tokens") / F.col("tokens"))).otherwise(0.0)
    )


def mix(sized: DataFrame, rates: DataFrame, *, seed: int = 42, bucket_rows: int = 50_000) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of every selected document.

    Defined cases: documents with a null source, of an unlisted source, or without tokens (null or
    empty text) take no part; repeated rows are documents of their own; a share or cap of 0 selects
    nothing; empty tables give an empty selection.
    """
    size_class = F.floor(F.log2(F.col("n_tokens")) * 2).cast("int")
    # buckets per source: from the largest source, so that a bucket stays near bucket_rows rows
    largest = rates.agg(F.max("documents")).first()[0] or 0
    hashes = max(1, -(-int(largest) // bucket_rows))
    taken = rates.where("rate > 0").select("source", "rate")
    members = (
        sized.where("n_tokens > 0")
        .join(taken, "source")
        .withColumn("bucket", F.struct(size_class.alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(hashes)).alias("part")))
    )
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = members.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = W.partitionBy("source", "bucket").orderBy("doc_id", "n_tokens")
    ranked = members.withColumn("k", F.row_number().over(inside)).join(totals.select("source", "bucket", "start"), ["source", "bucket"])
    upto = lambda k: F.floor(F.col("rate") * (F.col("start") + k) + _offset(F.col("source"), seed))
    copies = (upto(F.col("k")) - upto(F.col("k") - 1)).cast("int")
    return ranked.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mix_report(rates: DataFrame, selection: DataFrame) -> DataFrame:
    """Target and really reached share of every target source, also of those that gave nothing."""
    got = selection.groupBy("source").agg(
        F.count("*").alias("documents_used"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("copies").cast("bigint") * F.col("n_tokens")).alias("reached_tokens"),
    )
    rows = rates.join(got, "source", "left").fillna(0, ["documents_used", "copies", "most_copies", "reached_tokens"])
    total = rows.agg(F.sum("reached_tokens").alias("mix_tokens"))
    share = F.when(F.col("mix_tokens") > 0, F.col("reached_tokens") / F.col("mix_tokens")).otherwise(0.0)
    return rows.crossJoin(total).select(
        "source", "target_share", "max_repeats", "documents", "tokens", "target_tokens", "rate",
        "documents_used", "copies", "most_copies", "reached_tokens", share.alias("reached_share"),
        (F.col("rate") >= F.col("max_repeats")).alias("at_cap"),
    )
