"""Vector expressions and time-aware scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def valid_year(year: Column, low: int = 1900, high: int = 2100) -> Column:
    value = year.try_cast("int")
    return F.when(value.between(low, high), value)


def temporal_modulation(score: Column, year: Column, query_years: Column, weight: float = 0.3, tau: float = 8.0) -> Column:
    """``score * (1 + weight * exp(-distance / tau))``, distance to the nearest year of the query."""
    nearest = F.array_min(F.transform(query_years, lambda y: F.abs(y - year)))
    return F.when(year.isNull() | nearest.isNull(), score).otherwise(score * (1 + weight * F.exp(-nearest / tau)))


def band(score: Column, *cuts: tuple[float, object], default=0) -> Column:
    """The value of the first cut that the score reaches."""
    result = None
    for least, value in cuts:
        result = F.when(score >= least, F.lit(value)) if result is None else result.when(score >= least, F.lit(value))
    return result.otherwise(F.lit(default))
