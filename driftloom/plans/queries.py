"""Registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.operators.nested import chunk_children, flatten_records
from driftloom.plans import eval_queries, search_queries, text_queries
from driftloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = chunk_children(flatten_records(table(spark, folder, "llm_input")))
    return found.select(found.record_id.alias("input_id"), "list_name", "chunk_pos", "child_kind", "child_path")


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of every readable record with its parent: the tables that all others filter."""
    return flatten_records(table(spark, folder, "llm_input"))


_MODULES = (search_queries, text_queries, eval_queries)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Search, graded relevance and NDCG over all usable vectors."""
    return search_queries.ndcg_at_k(spark, folder)


def queries() -> dict[str, Query]:
    """The problem's queries first, then those of each family."""
    return {f.__name__: f for f in (p4_found, p4_nodes)} | {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
