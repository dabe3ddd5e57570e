"""Evaluation of ranked results and of answers: gains, support of claims, statistics of records."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftloom.operators.ordering import numbered, running_sums
from driftloom.plans.lineage import cut


def ndcg(ranked: DataFrame, k: int | Column, *, group: list[str], rank: str = "rank", relevance: str = "relevance") -> DataFrame:
    """Linear-gain NDCG of the first k; the ideal order is that of the same list. 0 without gain."""
    rel = F.coalesce(F.col(relevance), F.lit(0)).cast("double")
    place = F.row_number().over(W.partitionBy(*group).orderBy(rank))
    ideal = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(rel), rank))
    limit = k if isinstance(k, Column) else F.lit(k)
    gain = lambda at: F.when(F.col(at) <= limit, F.col("rel") / F.log2(F.col(at) + 1)).otherwise(0.0)
    placed = ranked.withColumn("rel", rel).withColumn("at", place).withColumn("best", ideal)
    sums = placed.groupBy(*group).agg(F.sum(gain("at")).alias("dcg"), F.sum(gain("best")).alias("idcg"))
    return sums.select(*group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def overlap_support(claim_words: Column, chunk_words: Column) -> Column:
    """Share of a claim's distinct words that the evidence holds: a stand-in for an entailment model."""
    return F.when(F.size(claim_words) > 0, F.size(F.array_intersect(claim_words, chunk_words)) / F.size(F.array_distinct(claim_words))).otherwise(0.0)


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, by the counts of distinct values and not over all rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    before = running_sums(counts, [value], F.col("n"), "before")
    return rows.join(before.select(value, (F.col("before") + (F.col("n") + 1) / 2).alias(out)), value, "left")


def bootstrap_means(values: DataFrame, *, value: str, order: str, iterations: int, seed: int, most: int = 4_000_000, block: int = 65_536) -> DataFrame:
    """Means of resamples with replacement; the index of a draw is a digest of seed, turn and slot.

    A task draws for a turn and a block of slots.  Up to ``most`` counted values are broadcast as one
    array (8 bytes each), so that a task sums what it draws and only one number for each turn and
    block moves.  Beyond that a task sends, for each block of values, the numbers that it drew there;
    blocks of values meet them in one join.
    """
    known = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.col(order))
    placed = cut(numbered(known, [order], "at").select("x", "at"))
    spark, n = values.sparkSession, placed.count()
    if not n:
        return spark.createDataFrame([], "turn bigint, mean double")
    steps = -(-n // block)
    work = spark.range(0, iterations * steps, 1, max(spark.sparkContext.defaultParallelism, min(iterations * steps // 16, 2000)))

    def drawn(task: int) -> tuple[int, np.ndarray]:
        turn, step = divmod(task, steps)
        head = hashlib.md5(f"{seed}-{turn}-".encode())
        out = np.empty(min(n, (step + 1) * block) - step * block, np.int64)
        for k, slot in enumerate(range(step * block, min(n, (step + 1) * block))):
            digest = head.copy()
            digest.update(str(slot).encode())
            out[k] = int.from_bytes(digest.digest()[:4], "big")
        return turn, out % n

    if n <= most:
        known_values, xs = placed.toArrow(), np.empty(n)
        xs[known_values["at"].to_numpy()] = known_values["x"].to_numpy()
        shared = spark.sparkContext.broadcast(xs)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(turn, float(shared.value[at].sum())) for turn, at in map(drawn, batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["turn", "s"])

        sums = work.mapInArrow(add, "turn bigint, s double")
    else:

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for turn, at in map(drawn, batch.column(0).to_pylist()):
                    at.sort()
                    blocks, first = np.unique(at // block, return_index=True)
                    picks = [p.astype(np.int32) for p in np.split(at % block, first[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), turn)), pa.array(blocks), pa.array(picks, pa.list_(pa.int32()))], ["turn", "b", "picks"])

        # one row for each block of values, of ``block`` values at most
        packed = placed.groupBy(F.floor(F.col("at") / block).alias("b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("xs"))
        draws = work.mapInArrow(pick, "turn bigint, b bigint, picks array<int>")
        sums = draws.join(packed, "b").select("turn", F.aggregate("picks", F.lit(0.0), lambda s, k: s + F.get("xs", k)).alias("s"))
    return sums.groupBy("turn").agg((F.sum("s") / F.lit(n)).alias("mean"))


def iqr_and_z_outliers(records: DataFrame, metrics: list[str], *, iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """Records outside the quartile fences or more than z population deviations off, in any metric."""
    aggregates = []
    for m in metrics:
        aggregates += [F.percentile(m, F.lit(0.25)).alias(f"{m}_q1"), F.percentile(m, F.lit(0.75)).alias(f"{m}_q3"), F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_sd")]
    flag = F.lit(False)
    for m in metrics:
        spread = F.col(f"{m}_q3") - F.col(f"{m}_q1")
        fences = (spread > 0) & ((F.col(m) < F.col(f"{m}_q1") - iqr * spread) | (F.col(m) > F.col(f"{m}_q3") + iqr * spread))
        far = (F.col(f"{m}_sd") > 0) & (F.abs(F.col(m) - F.col(f"{m}_mean")) > z * F.col(f"{m}_sd"))
        flag = flag | F.coalesce(fences, F.lit(False)) | F.coalesce(far, F.lit(False))
    # one row of statistics, joined to every record
    return records.crossJoin(F.broadcast(records.agg(*aggregates))).where(flag).select(*records.columns)


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def correlation_p_value(r: Column, pairs: Column) -> Column:
    """Two-sided p of a correlation of so many pairs, by the t distribution; null under three pairs."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or k < 3 else _beta_share(1 - min(1.0, a * a), (k - 2) / 2, 0.5) for a, k in zip(r, n)], dtype="float64")

    return p(r, pairs)
