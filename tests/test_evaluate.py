import math

import numpy as np

from fixtures import days
from rostercast.operators import evaluate as V


def test_fold_sizes_and_learning_sizes(spark):
    df = spark.createDataFrame([(x,) for x in days("2015-01-01", 887)], "date date")
    sizes = sorted(r["count"] for r in V.fold_ids(df, 5).groupBy("fold").count().collect())
    assert sizes == [177, 177, 177, 178, 178]
    first = V.fold_ids(df, 5).where("fold = 0").agg({"date": "max"}).first()[0]
    assert first == days("2015-01-01", 178)[-1]          # contiguous, unshuffled
    assert V.learning_sizes(709) == [70, 230, 389, 549, 709]


def test_hash_split(spark):
    df = spark.createDataFrame([(x,) for x in days("2000-01-01", 5000)], "date date")
    frac = V.hash_split(df, ["date"]).where("is_test").count() / 5000
    assert 0.17 < frac < 0.23
    ex = V.hash_split(df, ["date"], exact=True).where("is_test").count()
    assert ex == math.ceil(0.2 * 5000)
    a = {r["date"] for r in V.hash_split(df, ["date"]).where("is_test").collect()}
    b = {r["date"] for r in V.hash_split(df, ["date"]).where("is_test").collect()}
    assert a == b


def test_standardiser_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "x double, c double")
    stats = V.fit_standardiser(df, ["x", "c"])
    out = V.apply_standardiser(df, stats, ["x", "c"]).collect()
    xs = np.array([1.0, 2.0, 3.0, 4.0])
    assert np.allclose([r["x"] for r in out], (xs - xs.mean()) / xs.std(ddof=0))
    assert [r["c"] for r in out] == [0.0] * 4                     # zero variance → divisor 1


def test_regression_metrics(spark):
    y = np.array([3.0, 5.0, 2.0, 8.0])
    p = np.array([2.5, 5.0, 4.0, 7.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, prediction double")
    m = V.regression_metrics(df).first()
    mse = np.mean((y - p) ** 2)
    assert math.isclose(m["mse"], mse) and math.isclose(m["mae"], np.mean(np.abs(y - p)))
    assert math.isclose(m["rmse"], math.sqrt(mse))
    assert math.isclose(m["r2"], 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, prediction double")
    assert V.regression_metrics(const).first()["r2"] == 1.0
