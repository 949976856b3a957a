import datetime as dt
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import CHECK_DIR
from rostercast.sources.driver_tables import daily_ops, daily_ops_from
from rostercast.sources.files import read_daily, write_table


def _orders(n=20000, seed=5):
    """Order rows where one customer holds a third of all orders (skew fixture)."""
    rng = np.random.default_rng(seed)
    cust = np.where(rng.random(n) < 1 / 3, 7, rng.integers(1, 400, n))
    day0 = dt.datetime(2000, 1, 1)
    return pd.DataFrame({
        "o_orderkey": np.arange(n, dtype="int64"),
        "o_custkey": cust.astype("int64"),
        "o_orderstatus": rng.choice(["F", "O", "P"], n),
        "o_totalprice": rng.random(n),
        "o_orderdate": [day0 + dt.timedelta(days=int(x)) for x in rng.integers(0, 60, n)],
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], n),
    })


def _brute(pdf, cust=None):
    pdf = pdf.copy()
    pdf["date"] = pdf["o_orderdate"].dt.date
    keys = ["date"]
    if cust is not None:
        pdf = pdf.merge(cust, left_on="o_custkey", right_on="c_custkey")
        pdf["series"] = pdf["c_mktsegment"]
        keys = ["series", "date"]
    g = pdf.groupby(keys)
    out = pd.DataFrame({
        "n_sick": g.apply(lambda x: (x.o_orderpriority == "1-URGENT").sum(), include_groups=False),
        "calls": g.size(),
        "n_duty": g["o_custkey"].nunique(),
        "n_sby": g.apply(lambda x: (x.o_orderstatus == "P").sum(), include_groups=False),
        "sby_need": g.apply(lambda x: ((x.o_orderstatus == "F") & x.o_orderpriority.isin(["1-URGENT", "2-HIGH"])).sum(),
                            include_groups=False),
    }).reset_index()
    out["dafted"] = np.maximum(out["sby_need"] - out["n_sby"], 0)
    return out


def test_daily_ops_with_hot_customer_matches_brute_force(spark):
    pdf = _orders()
    cust = pd.DataFrame({"c_custkey": np.arange(1, 400, dtype="int64"),
                         "c_mktsegment": np.array(["A", "B", "C"])[np.arange(1, 400) % 3]})
    orders = spark.createDataFrame(pdf)
    customer = spark.createDataFrame(cust)
    for series in (None, "c_mktsegment"):
        got = daily_ops_from(orders, customer if series else None, series).toPandas()
        ref = _brute(pdf, cust if series else None)
        keys = ["series", "date"] if series else ["date"]
        got = got.sort_values(keys).reset_index(drop=True)
        ref = ref.sort_values(keys).reset_index(drop=True)
        assert len(got) == len(ref)
        for c in ["n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted"]:
            assert (got[c].to_numpy() == ref[c].to_numpy()).all(), c


def test_daily_ops_measure_subset_direct_path(spark):
    pdf = _orders(seed=9)
    cust = pd.DataFrame({"c_custkey": np.arange(1, 400, dtype="int64"),
                         "c_mktsegment": np.array(["A", "B", "C"])[np.arange(1, 400) % 3]})
    orders, customer = spark.createDataFrame(pdf), spark.createDataFrame(cust)
    cols = ["calls", "sby_need", "n_sby", "dafted"]
    for series in (None, "c_mktsegment"):
        got = daily_ops_from(orders, customer if series else None, series, cols).toPandas()
        ref = _brute(pdf, cust if series else None)
        keys = ["series", "date"] if series else ["date"]
        assert list(got.columns) == keys + ["calls", "n_sby", "sby_need", "dafted"]  # canonical order
        got = got.sort_values(keys).reset_index(drop=True)
        ref = ref.sort_values(keys).reset_index(drop=True)
        for c in cols:
            assert (got[c].to_numpy() == ref[c].to_numpy()).all(), c


def test_daily_ops_row_counts_at_sf001(spark):
    assert daily_ops(spark, CHECK_DIR).count() == 2399
    assert daily_ops(spark, CHECK_DIR, "c_mktsegment").count() == 8537


def test_csv_round_trip_drops_index_and_parses_dates(spark):
    df = spark.createDataFrame([(0, "2019-05-01", 60, 10000, 1900, 90, 80, 0), (1, "2019-05-02", 61, 9000, 1900, 90, 95, 5)],
                               "_idx long, date string, n_sick long, calls long, n_duty long, n_sby long, "
                               "sby_need long, dafted long")
    path = os.path.join(tempfile.mkdtemp(prefix="rc-csv-"), "daily")
    write_table(df, path, fmt="csv")
    back = read_daily(spark, path)
    assert "_idx" not in back.columns and dict(back.dtypes)["date"] == "date"
    assert sorted(r["date"] for r in back.collect()) == [dt.date(2019, 5, 1), dt.date(2019, 5, 2)]
    write_table(back, path + "-pq", fmt="parquet", key_first="date")
    assert read_daily(spark, path + "-pq", fmt="parquet").count() == 2


def test_iso_weeks_of_may_2019_golden(spark):
    # golden: the evaluation input table labels 2019-05-01…27 with ISO weeks 18…22
    from rostercast.functions.calendar import iso_week
    df = spark.range(27).select(F.date_add(F.lit("2019-05-01").cast("date"), F.col("id").cast("int")).alias("d"))
    weeks = [r["w"] for r in df.select(iso_week("d").alias("w")).orderBy("d").collect()]
    assert weeks == [18] * 5 + [19] * 7 + [20] * 7 + [21] * 7 + [22]


def test_daily_ops_approximate_duty_is_close(spark):
    exact = {(r["series"], r["date"]): r["n_duty"] for r in daily_ops(spark, CHECK_DIR, "c_mktsegment").collect()}
    approx = daily_ops(spark, CHECK_DIR, "c_mktsegment", approx_duty_rsd=0.01).collect()
    assert len(approx) == len(exact)
    errs = [abs(r["n_duty"] - exact[(r["series"], r["date"])]) / exact[(r["series"], r["date"])] for r in approx]
    assert max(errs) <= 0.05 and sum(e == 0 for e in errs) / len(errs) > 0.95
