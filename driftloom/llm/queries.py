"""Queries of the training-data operators; ``__spark_entry__`` adds them if this package is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.leaks import find_leaks
from driftloom.llm.mixing import mix, mix_report, mixing_rates, sized_documents
from driftloom.llm.names import linked_spellings, resolve_names
from driftloom.llm.neighbours import nearest_neighbours, neighbour_pairs
from driftloom.llm.responses import find_defects, truncation_evidence
from driftloom.llm.scans import find_noise, repair_fields
from driftloom.llm.splitting import split_texts
from driftloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_noise(table(spark, folder, "parsed"), table(spark, folder, "cleaned"))


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed and cleaned texts as readable paragraphs."""
    return repair_fields(table(spark, folder, "parsed"), table(spark, folder, "cleaned"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_defects(table(spark, folder, "llm_log"), table(spark, folder, "documents"))


def p2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """What shows that each truncated response is one."""
    return truncation_evidence(table(spark, folder, "llm_log"), table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(nearest_neighbours(table(spark, folder, "chunk_vectors")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_spellings(resolve_names(table(spark, folder, "metadata")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = sized_documents(table(spark, folder, "documents"))
    rates = mixing_rates(sized, table(spark, folder, "mix_targets"))
    return rates, mix(sized, rates)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Selected documents with the number of times that each is used."""
    return _mix(spark, folder)[1]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and really reached shares."""
    return mix_report(*_mix(spark, folder))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), table(spark, folder, "size_limits"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_evidence, p3_found, p5_found, p6_found, p7_mix, p7_shares, p8_pieces)}


def oracle_sql() -> dict[str, str]:
    """None of these can be stated in SQL over whole tables; their tests compare with brute force."""
    return {}
