import math
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from fixtures import days
from rostercast.operators import learn as L
from rostercast.operators.evaluate import hash_split, regression_metrics


def _planted(spark, n=2000):
    rng = np.random.default_rng(11)
    calls = rng.integers(8000, 12000, n)
    n_sick = rng.integers(50, 100, n)
    n_duty = rng.integers(1700, 2000, n)
    year = rng.integers(2016, 2020, n)
    need = np.maximum(0, 0.12 * calls - 2.0 * n_sick - 0.6 * n_duty)
    recs = [(dd, int(a), int(b), int(c), int(y), float(v)) for dd, a, b, c, y, v in
            zip(days("2010-01-01", n), calls, n_sick, n_duty, year, need)]
    return spark.createDataFrame(recs, "date date, calls long, n_sick long, n_duty long, year long, sby_need double")


def test_trees_beat_linear_on_planted(spark):
    df = hash_split(_planted(spark), ["date"]).cache()
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    lin = L.fit(train, L.PROD_FEATURES, L.linear_baseline())
    gbt = L.fit(train, L.PROD_FEATURES, L._gbt(maxIter=30, maxDepth=5, stepSize=0.3))
    m_lin = regression_metrics(L.score(lin, test), "sby_need", "prediction").first()["mse"]
    m_gbt = regression_metrics(L.score(gbt, test), "sby_need", "prediction").first()["mse"]
    base = test.agg(F.var_pop("sby_need")).first()[0]
    assert m_gbt < m_lin < base


def test_importance_and_selection(spark):
    df = _planted(spark, 600)
    imp = L.importance(spark, df, L.PROD_FEATURES, num_trees=20, max_depth=5)
    rows = imp.orderBy("rank").collect()
    assert math.isclose(sum(r["importance"] for r in rows), 1.0, rel_tol=1e-9)
    assert [r["importance"] for r in rows] == sorted([r["importance"] for r in rows], reverse=True)
    assert rows[0]["feature"] == "calls" and L.top_features(imp, 2)[0] == "calls"
    assert L.leaves_to_depth(31) == 5 and L.leaves_to_depth(100) == 7


def test_save_load_scores_equal(spark):
    df = _planted(spark, 300)
    model = L.fit(df, L.PROD_FEATURES, L._gbt(maxIter=5, maxDepth=3))
    path = os.path.join(tempfile.mkdtemp(prefix="rc-model-"), "m")
    L.save_model(model, path)
    again = L.load_model(path)
    a = [r["prediction"] for r in L.score(model, df).orderBy("date").collect()]
    b = [r["prediction"] for r in L.score(again, df).orderBy("date").collect()]
    assert a == b


def test_grid_search_and_search(spark):
    df = hash_split(_planted(spark, 400), ["date"])
    train, test = df.where(~F.col("is_test")), df.where("is_test")
    cand = L.CANDIDATES["Gradient Boosting Regressor"]
    grid = {"maxIter": [5], "stepSize": [0.1], "maxDepth": [2, 4]}
    _, best, metrics = L.grid_search(train, L.PROD_FEATURES, cand, grid=grid, parallelism=2)
    assert len(metrics) == 2 and best["maxDepth"] == [2, 4][int(np.argmin(metrics))]
    cfg = L.SearchConfig(models=["Gradient Boosting Regressor"], feature_counts=[1, 2], tune=False,
                         defaults={"Gradient Boosting Regressor": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}},
                         importance_trees=10)
    res = L.search(spark, train, test, cfg, features=L.PROD_FEATURES).collect()
    assert len(res) == 2 and sum(r["is_best"] for r in res) == 1
    best_row = [r for r in res if r["is_best"]][0]
    assert best_row["mse"] == min(r["mse"] for r in res)
    assert best_row["key"].startswith("Gradient Boosting Regressor (")


def test_fits_are_deterministic_under_seed(spark):
    df = _planted(spark, 300).cache()
    for make in (lambda: L._gbt(maxIter=5, maxDepth=3), lambda: L._rf(numTrees=5, maxDepth=3)):
        a = [r["prediction"] for r in L.score(L.fit(df, L.PROD_FEATURES, make()), df).orderBy("date").collect()]
        b = [r["prediction"] for r in L.score(L.fit(df, L.PROD_FEATURES, make()), df).orderBy("date").collect()]
        assert a == b
