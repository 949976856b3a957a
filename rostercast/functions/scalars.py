"""Attaching per-series scalars (cut-off, floor, scaler statistics, bin edges).

J4 of the inventory: a small aggregate used against every row.  No row of the
large side is ever lost: a series without a scalar row, and a NULL key without
one, comes out with NULL scalars; NULL keys match NULL keys.

Without series keys the scalar side must be one row.  It is reduced by an
aggregate without grouping, which proves that bound (a second row raises), so it
is broadcast: the large side is never shuffled.  With keys it is an equi-join;
the scalar side has one row per series and AQE broadcasts it when its measured
size is below ``spark.sql.autoBroadcastJoinThreshold``, otherwise it is a
sort-merge join on the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys come from ``left``."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys]
    return left.join(right, cond, how).drop(*[f"_right_{k}" for k in keys])


def attach_scalars(df: DataFrame, scalars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every row of ``df`` with the columns of ``scalars`` of its series (NULL where there are none)."""
    if keys:
        return join_on_keys(df, scalars, keys)
    rows = F.count(F.lit(1))
    one_row = (scalars.groupBy().agg(*[F.first(c).alias(c) for c in scalars.columns], rows.alias("_rows"))
               .withColumn("_one", F.when(F.col("_rows") > 1, F.raise_error(F.lit("more than one scalar row without keys")))
                           .otherwise(F.lit(1)).cast("int")).drop("_rows"))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row), "_one", "left").drop("_one")
