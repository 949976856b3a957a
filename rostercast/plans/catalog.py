"""Registered queries: one per operator of SURVEY §2, each with its oracle SQL.

Every query reads the driver tables of ``sf_dir`` and derives the daily
operations table from the full ``orders`` table (and ``customer`` for the
per-segment variants), so the work grows with the data.  Floating-point
outputs are rounded to 4 decimals on both sides of the oracle check only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.plans.prepare import prepare
from rostercast.sources.driver_tables import daily_ops

# Parameters of the dated operators at the driver's data (FIXTURES.md §2).
TRAIN_END = "2001-05-14"
HOLDOUT = ("2001-06-01", "2001-06-27")
SEGMENT = "c_mktsegment"
# Deterministic stand-in prediction used where a query needs "given predictions".
STANDIN_FACTOR = 0.25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round4(df: DataFrame) -> DataFrame:
    """Round every double column to 4 decimals (comparison convention)."""
    return df.select(*[F.round(F.col(c), 4).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def modeling(spark: SparkSession, sf_dir: str, segment: bool = False, extended: bool = False,
             columns: list[str] | None = None) -> DataFrame:
    """The prepared daily table; ``columns`` limits the measures derived from the orders."""
    raw = daily_ops(spark, sf_dir, SEGMENT if segment else None, columns)
    return prepare(raw, ["series"] if segment else [], extended=extended)


def standin(col: str = "calls") -> F.Column:
    return F.col(col) * F.lit(STANDIN_FACTOR)


def sql_standin(col: str = "calls") -> str:
    return f"({col} * CAST({STANDIN_FACTOR} AS DOUBLE))"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)
