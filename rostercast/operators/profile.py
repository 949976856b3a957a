"""Data-quality profiling (Q1-Q6) as DataFrames.

Each report is a single aggregate pass over the input (partial aggregation on
every task, one tiny shuffle) and is then unpivoted to long form with
``stack``/``inline`` on the one-row result — never on the input rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in exclude]


def preview(df: DataFrame, n: int = 5, order_by: str | list[str] = "date") -> DataFrame:
    """Q1: first ``n`` rows in an explicit order (a top-n, not a full sort)."""
    cols = [order_by] if isinstance(order_by, str) else order_by
    return df.orderBy(*cols).limit(n)


def columns_report(df: DataFrame) -> DataFrame:
    """Q2-Q4: ``(column, position, dtype, non_null, nulls, rows, n_columns)``."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(t).alias("dtype"),
                        F.col(f"_nn{i}").alias("non_null"))
               for i, (c, t) in enumerate(df.dtypes)]
    return (agg.select("_rows", F.inline(F.array(*entries)))
            .select("column", "position", "dtype", "non_null",
                    (F.col("_rows") - F.col("non_null")).alias("nulls"),
                    F.col("_rows").alias("rows"), F.lit(len(cols)).alias("n_columns")))


def distinct_report(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Q5: distinct non-null values per column.

    Exact by default (the reference's semantics).  Several exact distinct
    counts in one aggregate make Spark expand each row once per column; at
    scale pass ``approx=True`` (HyperLogLog++, one pass, no expansion).
    """
    cols = df.columns
    if approx:
        aggs = [F.approx_count_distinct(F.col(c), rsd).alias(f"_d{i}") for i, c in enumerate(cols)]
    else:
        aggs = [F.count_distinct(F.col(c)).alias(f"_d{i}") for i, c in enumerate(cols)]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_d{i}").cast("long").alias("n_distinct"))
               for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def describe_long(df: DataFrame, cols: list[str] | None = None, keys: list[str] | None = None,
                  approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Q6: count, mean, sample std, min, 25/50/75 % (linear interpolation), max.

    Long form ``(keys…, column, count, mean, std, min, p25, p50, p75, max)``.
    ``percentile`` is exact (holds the value counts of each group), which is
    fine for daily tables; ``approx=True`` switches to ``percentile_approx``.
    """
    keys = keys or []
    cols = cols or numeric_columns(df, tuple(keys))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q = (F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy) if approx
             else F.percentile(x, [0.25, 0.5, 0.75]))
        aggs += [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), q.alias(f"_q{i}"), F.max(x).alias(f"_hi{i}")]
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("count"), F.col(f"_m{i}").alias("mean"),
                        F.col(f"_s{i}").alias("std"), F.col(f"_lo{i}").alias("min"),
                        F.element_at(f"_q{i}", 1).alias("p25"), F.element_at(f"_q{i}", 2).alias("p50"),
                        F.element_at(f"_q{i}", 3).alias("p75"), F.col(f"_hi{i}").alias("max"))
               for i, c in enumerate(cols)]
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return grouped.select(*keys, F.inline(F.array(*entries)))
