"""Sinks: idempotent appends, upserts by key, and rendered summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("parquet", "json", "orc", "csv")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).format(kind).save(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; an error of the store is an error, not an empty table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not have yet; running it again adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by ``order``; rows equal in it are settled by their columns."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest)))
    return df.groupBy(key).agg(best.alias("row")).select(key, "row.*")


def render_markdown(summary: DataFrame, limit: int = 1000) -> str:
    """A small summary table as Markdown text; larger tables are refused."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: not a summary")
    cells = [summary.columns, ["---"] * len(summary.columns), *(["" if v is None else str(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in cells)


def render_latex(summary: DataFrame, limit: int = 1000) -> str:
    """A small summary table as a LaTeX tabular."""
    rows = summary.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: not a summary")
    special = str.maketrans({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}", "±": r"$\pm$"})
    cell = lambda v: "" if v is None else str(v).translate(special)
    lines = [" & ".join(map(cell, line)) + r" \\" for line in [summary.columns, *rows]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(summary.columns)}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])
