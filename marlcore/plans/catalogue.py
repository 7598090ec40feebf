"""All queries over the driver tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, cluster_queries, file_queries, graph_queries, omics_queries, rule_queries, table_queries, vector_queries, wall_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["silhouette_exact"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
