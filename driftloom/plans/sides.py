"""How a side of a join is moved: by its counted size, never by an estimate.

A checkpointed table keeps the size estimate of the files that it was made from, and an exploded one
is not scaled, so a plan may broadcast what has grown a hundredfold.  Here a side is broadcast only
after its rows and bytes were counted; beyond the bound both sides are shuffled and merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A broadcast side has at most so many rows and bytes of text.
MOST_ROWS, MOST_BYTES = 300_000, 32_000_000


def shuffled(side: DataFrame) -> DataFrame:
    """A side that is never broadcast by an estimate."""
    return side.hint("merge")


def of_rows(side: DataFrame, rows: int) -> DataFrame:
    """A side of numbers, of which so many rows were counted."""
    return F.broadcast(side) if rows <= MOST_ROWS else shuffled(side)


def counted(side: DataFrame, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> DataFrame:
    """A written side, broadcast if it was counted to be small, and shuffled if not."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in side.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = side.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0).cast("bigint"))).alias("b")).first()
    return F.broadcast(side) if total.n <= rows and (total.b or 0) <= size else shuffled(side)
