"""Bridge from the driver's order tables to the daily operations table.

The reference reads one pre-built daily CSV.  The test tables are order-level
facts, so the daily series is derived here (see FIXTURES.md §2):

    date      = CAST(o_orderdate AS DATE)
    n_duty    = COUNT(DISTINCT o_custkey)
    calls     = COUNT(*)
    n_sick    = count of o_orderpriority = '1-URGENT'
    n_sby     = count of o_orderstatus = 'P'
    sby_need  = count of o_orderstatus = 'F' and priority in ('1-URGENT', '2-HIGH')
    dafted    = GREATEST(sby_need - n_sby, 0)
    series    = a customer column (e.g. c_mktsegment) when a series key is asked for

Plan shape (the only step that touches the big tables):

1. scan ``orders`` with 4 columns (column pruning, no filter);
2. aggregate to one row per ``(o_custkey, date)`` with partial counts.  The
   partial/final hash aggregate combines map-side, and the exchange is keyed on
   the pair, so a customer or a day holding a third of all orders is still
   spread over many tasks;
3. (series only) join those pairs with ``customer(c_custkey, series)``.  After
   step 2 a hot customer has at most one row per day, so the join input has no
   skew left; the customer side is broadcast by AQE only if its measured size is
   below ``spark.sql.autoBroadcastJoinThreshold``, otherwise it is a sort-merge
   join;
4. aggregate the pairs to ``(series, date)``: the distinct-customer count is a
   plain ``count`` of pairs, so no Expand and no second distinct pass.

A single series without ``n_duty`` needs no pairs: its rows are aggregated straight
to days.  Per series the pairs come first always, so that no raw order row is
shuffled on a customer key that may be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The definition of the daily measures over order rows (FIXTURES.md §2).
SICK_PRIORITY = "1-URGENT"
STANDBY_STATUS = "P"
NEED_STATUS = "F"
NEED_PRIORITIES = ["1-URGENT", "2-HIGH"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


MEASURES = ["n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted"]


def daily_ops_from(orders: DataFrame, customer: DataFrame | None = None,
                   series_col: str | None = None, columns: list[str] | None = None,
                   approx_duty_rsd: float | None = None) -> DataFrame:
    """Daily operations table ``(series?, date, n_sick, calls, n_duty, n_sby, sby_need, dafted)``.

    ``columns`` restricts the measures.  The distinct-customer count (``n_duty``) and
    the join to series need the ``(customer, day)`` pair stage; a single series
    without ``n_duty`` is aggregated straight to days: map-side combine leaves at
    most one row per day and task, so the only exchange is small.
    ``approx_duty_rsd`` (opt-in, e.g. 0.01) computes ``n_duty`` with HyperLogLog++
    in that same single aggregation instead of the exact pair stage.
    """
    wanted = [c for c in MEASURES if columns is None or c in columns]
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    counts = {
        "calls": F.count(F.lit(1)),
        "n_sick": F.count_if(prio == SICK_PRIORITY),
        "n_sby": F.count_if(status == STANDBY_STATUS),
        "sby_need": F.count_if((status == NEED_STATUS) & prio.isin(NEED_PRIORITIES)),
    }
    base = orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), prio, status)
    if series_col is not None and customer is None:
        raise ValueError("a series column needs the customer table")
    keys: list[str] = []
    if series_col is None and "n_duty" not in wanted or approx_duty_rsd is not None:
        if "n_duty" in wanted:
            counts["n_duty"] = F.approx_count_distinct("o_custkey", approx_duty_rsd)
        if series_col is not None:
            # a sketch of the customers needs the order rows themselves at their series
            cust = customer.select(F.col("c_custkey").alias("o_custkey"), F.col(series_col).alias("series"))
            base = base.join(cust, "o_custkey", "inner")
            keys = ["series"]
        daily = base.groupBy(*keys, "date").agg(*[e.alias(c) for c, e in counts.items()])
    else:
        pairs = base.groupBy("o_custkey", "date").agg(*[e.alias(c) for c, e in counts.items()])
        if series_col is not None:
            cust = customer.select(F.col("c_custkey").alias("o_custkey"), F.col(series_col).alias("series"))
            pairs = pairs.join(cust, "o_custkey", "inner")
            keys = ["series"]
        duty = [F.count("o_custkey").alias("n_duty")] if "n_duty" in wanted else []
        daily = pairs.groupBy(*keys, "date").agg(*[F.sum(c).alias(c) for c in counts], *duty)
    daily = daily.withColumn("dafted", F.greatest(F.col("sby_need") - F.col("n_sby"), F.lit(0)))
    keys_out = ["series"] if series_col is not None else []
    return daily.select(*keys_out, "date", *wanted)


def daily_ops(spark: SparkSession, sf_dir: str, series_col: str | None = None,
              columns: list[str] | None = None, approx_duty_rsd: float | None = None) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders")
    customer = load_table(spark, sf_dir, "customer") if series_col else None
    return daily_ops_from(orders, customer, series_col, columns, approx_duty_rsd)


def daily_ops_sql(series_col: str | None = None) -> str:
    """The same derivation as ANSI SQL (used by the DuckDB oracle strings)."""
    if series_col:
        head = f"SELECT c.{series_col} AS series, CAST(o.o_orderdate AS DATE) AS date,"
        src = "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2"
    else:
        head = "SELECT CAST(o.o_orderdate AS DATE) AS date,"
        src = "FROM orders o GROUP BY 1"
    return f"""{head}
  CAST(COUNT(*) FILTER (WHERE o.o_orderpriority = '1-URGENT') AS BIGINT) AS n_sick,
  CAST(COUNT(*) AS BIGINT) AS calls,
  CAST(COUNT(DISTINCT o.o_custkey) AS BIGINT) AS n_duty,
  CAST(COUNT(*) FILTER (WHERE o.o_orderstatus = 'P') AS BIGINT) AS n_sby,
  CAST(COUNT(*) FILTER (WHERE o.o_orderstatus = 'F' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS sby_need,
  CAST(GREATEST(COUNT(*) FILTER (WHERE o.o_orderstatus = 'F' AND o.o_orderpriority IN ('1-URGENT', '2-HIGH'))
       - COUNT(*) FILTER (WHERE o.o_orderstatus = 'P'), 0) AS BIGINT) AS dafted
{src}"""
