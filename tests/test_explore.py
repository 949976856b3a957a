import math

import numpy as np
import pandas as pd

from fixtures import days
from rostercast.operators import explore as X
from rostercast.operators import profile as Q


def _frame(spark, n=90, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"date": days("2019-01-01", n), "a": rng.integers(0, 50, n).astype("int64"),
                        "b": rng.normal(10, 3, n), "c": np.full(n, 7.0)})
    pdf.loc[5, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype({"b": "float64"})).replace(float("nan"), None)


def test_describe_matches_pandas(spark):
    pdf, df = _frame(spark)
    got = {r["column"]: r for r in Q.describe_long(df, ["a", "b", "c"]).collect()}
    ref = pdf[["a", "b", "c"]].describe()
    for c in ["a", "b", "c"]:
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(got[c][ours], ref.loc[theirs, c], rel_tol=1e-9, abs_tol=1e-9), (c, ours)


def test_columns_and_distinct_reports(spark):
    pdf, df = _frame(spark)
    rep = {r["column"]: r for r in Q.columns_report(df).collect()}
    assert rep["b"]["nulls"] == 1 and rep["a"]["nulls"] == 0 and rep["a"]["rows"] == 90
    assert rep["date"]["dtype"] == "date" and rep["a"]["n_columns"] == 4
    dist = {r["column"]: r["n_distinct"] for r in Q.distinct_report(df).collect()}
    assert dist == {c: pdf[c].nunique() for c in pdf.columns}
    approx = {r["column"]: r["n_distinct"] for r in Q.distinct_report(df, approx=True).collect()}
    assert approx["c"] == 1


def test_corr_matches_pandas(spark):
    pdf, df = _frame(spark)
    got = {(r["x"], r["y"]): r["r"] for r in X.corr_long(df, ["a", "b", "c"]).collect()}
    ref = pdf[["a", "b"]].corr()
    assert math.isclose(got[("a", "b")], ref.loc["a", "b"], rel_tol=1e-9)
    assert got[("b", "a")] == got[("a", "b")] and got[("a", "a")] == 1.0
    assert got[("a", "c")] is None and got[("c", "c")] is None  # constant column


def _statsmodels_like(x, period):
    """Brute-force additive decomposition (moving-average filter + phase means)."""
    n = len(x)
    if period % 2 == 0:
        w = np.r_[0.5, np.ones(period - 1), 0.5] / period
    else:
        w = np.ones(period) / period
    half = len(w) // 2
    trend = np.full(n, np.nan)
    for i in range(half, n - half):
        trend[i] = np.dot(w, x[i - half:i + half + 1])
    det = x - trend
    means = np.array([np.nanmean(det[i::period]) for i in range(period)])
    means -= means.mean()
    seasonal = np.tile(means, n // period + 1)[:n]
    return trend, seasonal, x - trend - seasonal


def test_decompose_sine_30(spark):
    n = 120
    t = np.arange(n)
    x = 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 30)
    df = spark.createDataFrame([(dd, float(v)) for dd, v in zip(days("2019-01-01", n), x)], "date date, y double")
    rows = X.decompose(df, ["y"], 30).orderBy("date").collect()
    trend = np.array([np.nan if r["trend"] is None else r["trend"] for r in rows])
    assert np.isnan(trend[:15]).all() and np.isnan(trend[-15:]).all() and not np.isnan(trend[15:-15]).any()
    ref_t, ref_s, ref_r = _statsmodels_like(x, 30)
    assert np.allclose(trend[15:-15], ref_t[15:-15], atol=1e-9)
    assert np.allclose([r["seasonal"] for r in rows], ref_s, atol=1e-9)
    assert np.allclose(trend[15:-15], (100 + 0.5 * t)[15:-15], atol=1e-9)  # linear trend recovered


def test_decompose_odd_period_and_series(spark):
    rng = np.random.default_rng(1)
    recs = []
    for k in ("a", "b"):
        x = rng.normal(0, 1, 50)
        recs += [(k, dd, float(v)) for dd, v in zip(days("2020-01-01", 50), x)]
    df = spark.createDataFrame(recs, "k string, date date, y double")
    out = X.decompose(df, ["y"], 7, keys=["k"]).orderBy("k", "date").collect()
    for k in ("a", "b"):
        x = np.array([r[2] for r in recs if r[0] == k])
        ref_t, ref_s, _ = _statsmodels_like(x, 7)
        got = [r for r in out if r["k"] == k]
        assert np.allclose([np.nan if r["trend"] is None else r["trend"] for r in got], ref_t, equal_nan=True)
        assert np.allclose([r["seasonal"] for r in got], ref_s)


def test_pivot_and_means(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 4.0), (1, 3, 5.0), (2, 6, 1.0)], "month int, dow int, v double")
    p = {r["month"]: r for r in X.pivot_mean(df, "month", "dow", list(range(7)), ["v"]).collect()}
    assert p[1]["v_0"] == 3.0 and p[1]["v_3"] == 5.0 and p[1]["v_1"] is None and p[2]["v_6"] == 1.0
    w = {r["day_of_week"]: r["weekday_label"] for r in
         X.weekday_means(df.withColumnRenamed("dow", "day_of_week"), ["v"]).collect()}
    assert w == {0: "Mo", 3: "Do", 6: "So"}


def test_binned_pairs_and_density(spark):
    pdf, df = _frame(spark)
    pairs = X.binned_pairs(df, ["a", "b", "c"], bins=5)
    tot = {(r["x"], r["y"]): 0 for r in pairs.collect()}
    for r in pairs.collect():
        tot[(r["x"], r["y"])] += r["n"]
    assert tot[("a", "c")] == 90 and tot[("a", "b")] == 89
    dens = X.density(df, ["a"], grid=400, cut=3.0).orderBy("gi").collect()
    xs = np.array([r["x"] for r in dens])
    ys = np.array([r["density"] for r in dens])
    assert abs(np.trapezoid(ys, xs) - 1.0) < 1e-3
