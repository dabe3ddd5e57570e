"""Chunks of sentences, as folds over arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ACC = "struct<o:array<string>,c:string>"


def sentences_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\r\n]+"), lambda s: s != "")


def split_long(sentences: Column, size: int) -> Column:
    """Sentences longer than a chunk cut to its size."""
    return F.flatten(F.transform(sentences, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / size).cast("int")), lambda k: F.substring(s, k * size + 1, F.lit(size)))))


def _acc(chunks: Column, current: Column) -> Column:
    return F.struct(chunks.cast("array<string>").alias("o"), current.cast("string").alias("c"))


def fold_chunks(sentences: Column, size: Column | int, least: int, *, bounded: bool = True) -> Column:
    """Consecutive sentences joined by a blank while they fit ``size``; a last piece shorter than
    ``least`` goes to the chunk before it (only while that stays within the size if ``bounded``)."""
    limit = size if isinstance(size, Column) else F.lit(size)

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["c"] == "", s).otherwise(F.concat(acc["c"], F.lit(" "), s))
        fits = (F.length(joined) <= limit) | (acc["c"] == "")
        return F.when(fits, _acc(acc["o"], joined)).otherwise(_acc(F.array_append(acc["o"], acc["c"]), s))

    def finish(acc: Column) -> Column:
        last = F.element_at(acc["o"], -1)
        merged = F.concat(last, F.lit(" "), acc["c"])
        short = (F.length(acc["c"]) < least) & (F.size(acc["o"]) > 0)
        if bounded:
            short = short & (F.length(F.coalesce(merged, F.lit(""))) <= limit)
        before = F.slice(acc["o"], F.lit(1), F.greatest(F.size(acc["o"]) - 1, F.lit(0)))
        return F.when(acc["c"] == "", acc["o"]).when(short, F.array_append(before, merged)).otherwise(F.array_append(acc["o"], acc["c"]))

    start = F.from_json(F.lit('{"o":[],"c":""}'), _ACC)
    return F.aggregate(sentences, start, step, finish)


def static_chunks(text: Column, size: int = 384, least: int = 100) -> Column:
    """Chunks of at most ``size`` characters."""
    return fold_chunks(split_long(sentences_of(text), size), size, least)


def adaptive_size(pages: Column) -> Column:
    """Chunk size and overlap by the number of pages; (1000, 200) if unknown."""
    pair = lambda a, b: F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap"))
    return F.when(pages > 50, pair(1000, 700)).when(pages > 30, pair(1500, 500)).when(pages > 10, pair(2000, 300)).when(pages.isNotNull(), pair(2500, 200)).otherwise(pair(1000, 200))


def adaptive_size_by_length(length: Column) -> Column:
    pair = lambda a, b: F.struct(F.lit(a).alias("size"), F.lit(b).alias("overlap"))
    return F.when(length > 5000, pair(1000, 600)).when(length > 2000, pair(1500, 400)).otherwise(pair(2000, 200))
