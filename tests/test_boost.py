"""The boosted learners against plain ones, staged rounds, the ledger and odd rows."""

import json

import numpy as np
import pytest
from fixtures import days
from pyspark.sql import functions as F
from rostercast.operators import boost as B
from rostercast.operators import evaluate as V
from rostercast.plans.catalog import QUERIES  # noqa: F401


def plain_tree(X, g, spec):
    """A regression tree by trying every split of every leaf, as nested tuples."""
    def side(v):
        return v.sum() ** 2 / (len(v) + spec.l2) if len(v) else 0.0

    def best(m):
        found = (1e-12, None)
        for f in range(X.shape[1]):
            for t in np.unique(X[m, f])[:-1]:
                lo = X[m, f] <= t
                if min(lo.sum(), (~lo).sum()) >= spec.min_rows:
                    gain = 0.5 * (side(g[m][lo]) + side(g[m][~lo]) - side(g[m])) - spec.gamma
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, t))
        return found

    leaves = [(np.arange(len(g)), 0)]
    values = np.zeros(len(g))
    if spec.growth == "level":
        done = []
        while leaves:
            m, d = leaves.pop()
            split = best(m)[1] if d < spec.depth else None
            if split:
                lo = X[m, split[0]] <= split[1]
                leaves += [(m[lo], d + 1), (m[~lo], d + 1)]
            else:
                done.append(m)
    else:
        done = [leaves[0][0]]
        while len(done) < spec.leaves:
            offers = [(best(m), i) for i, m in enumerate(done)]
            (gain, split), i = max(offers, key=lambda o: o[0][0])
            if split is None:
                break
            m = done.pop(i)
            lo = X[m, split[0]] <= split[1]
            done += [m[lo], m[~lo]]
    for m in done:
        values[m] = spec.rate * g[m].sum() / (len(m) + spec.l2)
    return values


@pytest.mark.parametrize("spec", [B.Boosting("level", 4, 0.3, depth=3), B.Boosting("level", 4, 0.3, depth=4, l2=1.0, gamma=0.4, min_rows=3),
                                  B.Boosting("leaf", 4, 0.2, leaves=9, min_rows=4), B.Boosting("leaf", 3, 0.5, leaves=5, l2=2.0)])
def test_trees_equal_brute_force(spec):
    rng = np.random.default_rng(1)
    X = np.column_stack([rng.integers(0, 9, 150), rng.normal(size=150).round(2), rng.integers(0, 2, 150)]).astype(float)
    y = X[:, 0] * X[:, 1] + rng.normal(0, 0.3, 150)
    edges = [np.unique(X[:, j]) for j in range(3)]
    e = B.boosted(X, y, edges, spec)
    want = np.full(150, y.mean())
    for got in e.staged(X):
        want = want + plain_tree(X, y - want, spec)
        assert np.allclose(got, want)


def test_oblivious_levels_share_a_split_and_ordered_values_come_from_before():
    rng = np.random.default_rng(2)
    X = rng.integers(0, 6, (200, 3)).astype(float)
    y = X[:, 0] + 2 * (X[:, 1] > 2) + rng.normal(0, 0.1, 200)
    spec = B.Boosting("oblivious", 20, 0.3, depth=3, l2=3.0, ordered=True)
    e = B.boosted(X, y, [np.arange(6.0)] * 3, spec)
    for t in e.trees:
        level = [0]
        while level and t.feature[level[0]] >= 0:
            assert len({(t.feature[i], t.threshold[i]) for i in level}) == 1
            level = [c for i in level for c in (t.left[i], t.right[i])]
    assert np.mean((e.predict(X) - y) ** 2) < 0.1 * y.var()
    leaf, g = np.array([0, 1, 0, 0, 1]), np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(B.earlier_values(leaf, g, spec), 0.3 * np.array([0, 0, 1 / 4, 4 / 5, 2 / 4]))


def _frame(spark, n=300):
    rng = np.random.default_rng(3)
    recs = [(dd, float(a), int(b), float(3 * b + a * a)) for dd, a, b in zip(days("2018-01-01", n), rng.normal(size=n), rng.integers(0, 5, n))]
    return spark.createDataFrame(recs, "date date, `a b` double, `a-b` int, sby_need double")


FEATURES = ["a b", "a-b"]


def test_rounds_are_prefixes_of_one_fit(spark):
    df = _frame(spark)
    spec = B.Boosting("level", 20, 0.1, depth=2)
    test = df.where("`a-b` = 1").withColumn("date", F.date_add("date", 1000))
    staged = {(r.fold, r.rounds): r.mse for r in B.fit_errors(df, FEATURES, [(spec, FEATURES, [5, 20])], 3, test).collect()}
    short = {(r.fold, r.rounds): r.mse for r in B.fit_errors(df, FEATURES, [(spec, FEATURES, [5])], 3, test).collect()}
    assert len(staged) == 8 and all(staged[k] == v for k, v in short.items())
    whole = B.score_boosting(B.fit_boosting(df, FEATURES, spec), test, FEATURES)
    assert np.isclose(V.regression_metrics(whole, "sby_need").first()["mse"], staged[-1, 20])


def test_a_stopped_search_goes_on_where_it_was(spark, tmp_path):
    df = _frame(spark, 120)
    shapes = [(B.Boosting("level", 6, r, depth=2), FEATURES[:n], [3, 6]) for r in (0.1, 0.3) for n in (1, 2)]
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    whole = rows(B.fit_errors(df, FEATURES, shapes, 3))
    path = str(tmp_path / "ledger")
    half = B.fit_errors(df, FEATURES, shapes, 3, ledger=path, batch=4, batches=1)
    assert half.select("task").distinct().count() == 4
    files = {f.name for f in (tmp_path / "ledger").iterdir()}
    assert rows(B.fit_errors(df, FEATURES, shapes, 3, ledger=path, batch=4)) == whole
    assert files <= {f.name for f in (tmp_path / "ledger").iterdir()}  # nothing was done twice
    assert rows(spark.read.parquet(path)) == whole
    other = B.fit_errors(df.withColumn("sby_need", F.col("sby_need") + 1), FEATURES, shapes[:1], 3, ledger=path)
    assert other.count() == 6 and spark.read.parquet(path).count() == len(whole) + 6


def test_search_marks_the_least_cv_error(spark, monkeypatch):
    monkeypatch.setitem(B.GRIDS, "Gradient Boosting Regressor", {"rounds": [3, 9], "rate": [0.1, 0.4], "depth": [1, 2]})
    monkeypatch.setitem(B.PROFILES, "Gradient Boosting Regressor", B.Boosting("level", 5, 0.1, depth=2))
    df = V.hash_split(_frame(spark), ["date"])
    out = B.boosting_search(spark, df.where("not is_test"), df.where("is_test"), FEATURES, ["Gradient Boosting Regressor"], k=4).collect()
    assert len(out) == 2 * 9 and sum(r.is_best for r in out) == 1 and all(r.mse > 0 for r in out)
    best = next(r for r in out if r.is_best)
    assert best.cv_mse == min(r.cv_mse for r in out) and json.loads(best.params)["rounds"] == best.rounds


def test_odd_rows(spark):
    df = _frame(spark, 60)
    holes = df.unionByName(df.limit(5).withColumn("a b", F.lit(None).cast("double"))).unionByName(df.limit(5).withColumn("sby_need", F.lit(None).cast("double")))
    spec = B.Boosting("leaf", 3, 0.3, leaves=4)
    same = [r.prediction for r in B.score_boosting(B.fit_boosting(df, FEATURES, spec), df, FEATURES).orderBy("date").collect()]
    model = B.fit_boosting(holes.repartition(3), FEATURES, spec)
    assert len(same) == 60 and model.count() == 1
    scored = B.score_boosting(model, holes, FEATURES).collect()
    assert len(scored) == 70 and sum(r.prediction is None for r in scored) == 5
    none = B.fit_boosting(df.where("false"), FEATURES, spec)
    assert [r.prediction for r in B.score_boosting(none, df, FEATURES).collect()] == [None] * 60
    keyed = df.withColumn("k", F.when(F.col("a-b") > 1, F.lit("x"))).withColumn("prediction_of", F.lit(1))
    per = B.score_boosting(B.fit_boosting(keyed, FEATURES, spec, keys=["k"]), keyed, FEATURES, ["k"])
    assert per.count() == 60 and per.where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        B.MAX_ROWS, kept = 10, B.MAX_ROWS
        try:
            B.fit_boosting(df, FEATURES, spec)
        finally:
            B.MAX_ROWS = kept


def test_folds_keep_days_together_without_a_global_window(spark):
    rng = np.random.default_rng(9)
    recs = [(dd, i) for dd in days("2015-01-01", 200) for i in range(int(rng.integers(1, 6)))] + [(None, 0), (None, 1)]
    df = spark.createDataFrame(recs, "date date, i int").repartition(4)
    out = V.fold_ids(df, 5)
    rows = out.collect()
    assert len(rows) == len(recs)
    assert max(len({r.fold for r in rows if r.date == d}) for d in {r.date for r in rows}) == 1
    order = sorted({(r.fold, r.date is not None, r.date or days("1990-01-01", 1)[0]) for r in rows}, key=lambda x: x[1:])
    assert [f for f, *_ in order] == sorted(f for f, *_ in order) and {f for f, *_ in order} == set(range(5))
    # one partition only ever sees partial aggregates, never the rows of a window
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(plan):
        if "SinglePartition" in line:
            assert "partial_" in plan[i + 1], plan[i + 1]
        if "Window [" in line:
            assert "trunc(date" in line or "_month" in line
