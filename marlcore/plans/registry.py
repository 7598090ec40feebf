"""Queries by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_workers_import

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


class Tables:
    """The driver tables, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def vectors(self) -> DataFrame:
        from ..operators.vectors import vector_table

        return vector_table(self.embeddings, "vec_id", "embedding", "label")


def r(c, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


#: SQL of the feature table, of its long form and of all ordered pairs.
E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, label AS y FROM embeddings)"
LONG = E + ", l AS (SELECT id, y, unnest(range(len(f))) AS dim, unnest(f) AS v FROM e)"
PAIRS = E + ", d AS (SELECT a.id AS src, b.id AS dst, list_distance(a.f, b.f) AS w, a.y AS y1, b.y AS y2 FROM e a JOIN e b ON a.id <> b.id)"


def knn_sql(k: int) -> str:
    return PAIRS + f", k AS (SELECT * FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS rn FROM d) WHERE rn <= {k})"
