"""Numbers and running sums over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftloom.plans.lineage import cut


def running_sums(rows: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before each; ``order`` must tell the rows apart.

    Rows are partitioned by range; windows run inside the partitions, and over one row per partition.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    placed = cut(rows.repartitionByRange(max(2, cores), *order).withColumn("__value", value.cast("bigint")).withColumn("__part", F.spark_partition_id()))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    parts = placed.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(before.orderBy("__part")), none).alias("__start"))
    inside = F.coalesce(F.sum("__value").over(before.partitionBy("__part").orderBy(*order)), none)
    return placed.join(starts, "__part").withColumn(out, inside + F.col("__start")).drop("__part", "__value", "__start")


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``out``: the number of each row from 0."""
    return running_sums(rows, order, F.lit(1), out)


def numbered_within(rows: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """``out``: the number of each row from 1 within its group, however large one group is."""
    all_numbered = numbered(rows, [group, order], "__n")
    first = all_numbered.groupBy(group).agg(F.min("__n").alias("__first"))
    return all_numbered.join(first, group).withColumn(out, (F.col("__n") - F.col("__first") + 1).cast("int")).drop("__n", "__first")
