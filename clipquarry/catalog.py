"""All queries of the engine by name, with the SQL that tells their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregate_queries, fold_queries, interval_queries, record_queries, scores, stages, text_queries

Query = Callable[[SparkSession, str], DataFrame]


_MODULES = (aggregate_queries, fold_queries, interval_queries, record_queries, scores, stages, text_queries)


def queries() -> dict[str, Query]:
    return {k: q for m in _MODULES for k, q in m.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.oracles.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["golden_recall_precision"](spark, sf_dir)
