"""Work for all cores where a small table would otherwise be read by a few tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, shuffled only if it has fewer partitions than the session has cores.

    For narrow passes with much work per row.  A large table has many partitions and stays as it is.
    Only for scans with projections and filters: their partitions are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
