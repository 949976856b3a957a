"""File sources and sinks.

All paths are arguments (D14).  Reads use an explicit schema, so there is no
inference pass over the data and the scan only decodes the projected columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNT_COLUMNS = ["n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted"]

# Raw daily file: a stray unnamed index column first, then the day and six counts.
RAW_DAILY_SCHEMA = T.StructType(
    [T.StructField("_idx", T.LongType()), T.StructField("date", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in COUNT_COLUMNS]
)


def read_daily(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType | None = RAW_DAILY_SCHEMA) -> DataFrame:
    """Read a raw daily table, drop the index column, parse ``date``.

    ``fmt='parquet'`` reads the same layout from Parquet (schema from the file).
    """
    if fmt == "csv":
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if "_idx" in df.columns:
        df = df.drop("_idx")
    if dict(df.dtypes).get("date") != "date":
        df = df.withColumn("date", F.to_date(F.col("date").cast("string"), "yyyy-MM-dd"))
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None) -> DataFrame:
    """Read an intermediate table written by ``write_table``."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", key_first: str | None = None,
                partition_by: list[str] | None = None) -> None:
    """Overwrite ``path`` with ``df`` (a directory of part files).

    ``key_first`` moves the index-like column (date, model name) to the front,
    as the reference writes its index first.  No ``coalesce(1)``: every task
    writes its own part, so the sink scales with the cluster.
    """
    if key_first:
        df = df.select(key_first, *[c for c in df.columns if c != key_first])
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
