import numpy as np
from pyspark.sql import functions as F

from fixtures import days
from rostercast.functions import calendar as cal
from rostercast.operators import forecast as FC


def _history(spark, n=800, keys=("a", "b")):
    rng = np.random.default_rng(7)
    recs = []
    for i, k in enumerate(keys):
        t = np.arange(n)
        y = 50 + 5 * i + 0.01 * t + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, n)
        recs += [(k, dd, float(v)) for dd, v in zip(days("2016-01-01", n), y)]
    df = spark.createDataFrame(recs, "series string, date date, y double")
    return cal.with_calendar(df, extended=True)


def test_forecast_bands_and_rows(spark):
    hist = _history(spark)
    for spec in (FC.SICK_SPEC, FC.CALLS_SPEC):
        h = FC.regressor_frame(hist, "y", spec.regressors, ["series"])
        model = FC.fit_forecast(h, spec, ["series"])
        bounds = hist.select("series").distinct().select("series", F.lit("2018-04-01").cast("date").alias("s"),
                                                        F.lit("2018-04-30").cast("date").alias("e"))
        fut = cal.with_calendar(cal.date_spine(bounds, "s", "e", "ds"), "ds", extended=True)
        pred = FC.predict_forecast(model, fut.select("series", "ds", *spec.regressors)).collect()
        assert len(pred) == 60
        assert all(r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] for r in pred)
        level = {k: np.mean([r["yhat"] for r in pred if r["series"] == k]) for k in ("a", "b")}
        assert 50 < level["a"] < 65 and level["b"] > level["a"]


def test_single_series_fit_and_metrics(spark):
    hist = _history(spark, keys=("a",)).drop("series")
    h = FC.regressor_frame(hist, "y", FC.SICK_SPEC.regressors)
    model = FC.fit_forecast(h, FC.SICK_SPEC)
    fitted = FC.predict_forecast(model, h.drop("y"))
    met = FC.forecast_metrics(h, fitted).first()
    assert met["n"] == 800 and met["rmse"] < 2.0 and abs(met["mean_ratio"] - 1) < 0.05


def test_changepoints_positions(spark):
    df = spark.createDataFrame([("k", x) for x in days("2019-01-01", 101)], "series string, ds date")
    cps = FC.changepoints(df, ["series"], "ds", 25, 0.8).first()["cp_dates"]
    # h = floor(0.8 * 101) = 80 → positions round_half_even(j * 79 / 25), j = 1..25
    pos = sorted({int(np.round(j * (79 / 25))) for j in range(1, 26)})
    assert cps == [days("2019-01-01", 101)[p] for p in pos]


def test_combine_inputs_prod_and_dev(spark):
    a = spark.createDataFrame([(x, 10.7, 0.0, 0.0) for x in days("2019-06-01", 3)],
                              "ds date, yhat double, yhat_lower double, yhat_upper double")
    b = a.withColumn("yhat", F.lit(70.9))
    prod = FC.combine_inputs(a, b)
    assert prod.columns == ["date", "calls", "n_sick", "year", "n_duty"]
    r = prod.first()
    assert (r["calls"], r["n_sick"], r["n_duty"], r["year"]) == (10, 70, 1900, 2019)
    dev = FC.combine_inputs(a, b, integer_inputs=False, with_week=True)
    assert dev.columns == ["date", "calls", "year", "week", "n_duty", "n_sick"] and dev.first()["calls"] == 10.7


def test_trend_basis_columns(spark):
    df = spark.createDataFrame([("k", x) for x in days("2019-01-01", 101)], "series string, ds date")
    out = FC.trend_basis(df, df, ["series"], "ds").orderBy("ds").collect()
    assert out[0]["t"] == 0.0 and out[-1]["t"] == 1.0
    assert all(r["cp_1"] >= 0 for r in out) and out[0]["cp_25"] == 0.0
    # a hinge starts at its changepoint: zero before, linear after
    first_cp = next(i for i, r in enumerate(out) if r["cp_1"] > 0) - 1
    assert abs(out[-1]["cp_1"] - (1.0 - first_cp / 100)) < 1e-12


def test_linear_series_is_recovered(spark):
    spec = FC.ForecastSpec(n_changepoints=0, seasonalities=(), regressors=())
    recs = [("k", dd, 3.0 + 2.0 * i) for i, dd in enumerate(days("2019-01-01", 60))]
    h = spark.createDataFrame(recs, "series string, ds date, y double")
    model = FC.fit_forecast(h, spec, ["series"])
    fut = spark.createDataFrame([("k", x) for x in days("2019-03-02", 5)], "series string, ds date")
    got = [r["yhat"] for r in FC.predict_forecast(model, fut).orderBy("ds").collect()]
    assert np.allclose(got, [3.0 + 2.0 * i for i in range(60, 65)], atol=1e-6)


def _design(rng, n=400, k=8):
    t = np.linspace(0, 1, n)
    knots = np.linspace(0.05, 0.8, k)
    return np.column_stack([np.ones(n), t, *[np.maximum(t - c, 0) for c in knots]]), t


def _brute_lasso(Q, r, penalty):
    """Every sign pattern of a small problem."""
    from itertools import product

    best = (np.inf, None)
    for signs in product((-1, 0, 1), repeat=len(r)):
        s = np.array(signs)
        on = np.flatnonzero(s)
        d = np.zeros(len(r))
        if len(on):
            d[on] = np.linalg.lstsq(Q[np.ix_(on, on)], r[on] - penalty * s[on], rcond=None)[0]
        if (np.sign(d) == s).all():
            best = min(best, (d @ Q @ d / 2 - r @ d + penalty * np.abs(d).sum(), tuple(d)))
    return np.array(best[1])


def test_lasso_equals_every_sign_pattern():
    rng = np.random.default_rng(3)
    for _ in range(20):
        A = rng.normal(size=(30, 6)) @ np.diag([1, 1, 1, 1, 1, 0 if rng.random() < 0.3 else 1])
        Q, r, lam = A.T @ A, A.T @ rng.normal(size=30) * 3, rng.uniform(0.1, 20)
        assert np.allclose(FC.lasso(Q, r, lam, np.zeros(6)), _brute_lasso(Q, r, lam), atol=1e-9)


def test_sparse_trend_meets_optimality_and_is_sparse():
    rng = np.random.default_rng(4)
    X, t = _design(rng, k=25)
    y = 1 + 0.3 * t - 0.8 * np.maximum(t - 0.5, 0) + rng.normal(0, 0.05, len(t))
    spec = FC.ForecastSpec(seasonalities=(), regressors=())

    def moments(coef):
        Z = FC.linearised(X, y, coef, spec)
        return FC.moments_of(Z.T @ Z, len(y))

    coef, sd, noise, n = FC.fit_moments(moments, spec)
    gradient = X.T @ (y - X @ coef)
    limit = noise ** 2 / spec.changepoint_prior_scale
    d, g = coef[2:], gradient[2:]
    assert abs(gradient[0]) < 1e-8 and abs(gradient[1] - coef[1] * noise ** 2 / 25) < 1e-8
    assert np.allclose(g[d != 0], limit * np.sign(d[d != 0]), atol=1e-8) and (np.abs(g) <= limit * (1 + 1e-6)).all()
    assert 1 <= np.count_nonzero(d) <= 8 and abs(sd - 0.05) < 0.01


def test_multiplicative_recovers_what_a_log_fit_misses(spark):
    """A wave of one term around a trend: its logarithm is no such wave."""
    rng = np.random.default_rng(6)
    n = 900
    t = np.arange(n + 60)
    truth = (20 + 0.1 * t) * (1 + 0.9 * np.sin(2 * np.pi * t / 90))
    spec = FC.ForecastSpec(mode="multiplicative", n_changepoints=5, seasonalities=(FC.Seasonality("wave", 90.0, 1),))
    dates = days("2016-01-01", n + 60)
    h = spark.createDataFrame([(dd, float(v)) for dd, v in zip(dates, truth[:n] + rng.normal(0, 0.2, n))], "ds date, y double")
    fut = spark.createDataFrame([(x,) for x in dates[n:]], "ds date")
    truth = truth[n:]
    model = FC.fit_forecast(h, spec)
    rows = FC.predict_forecast(model, fut).orderBy("ds").collect()
    assert np.abs(np.array([r["yhat"] for r in rows]) - truth).max() < 1.0
    logs = FC.fit_forecast(h.withColumn("y", F.log1p(F.greatest("y", F.lit(0.0)))), FC.ForecastSpec(n_changepoints=5, seasonalities=spec.seasonalities))
    missed = np.expm1([r["yhat"] for r in FC.predict_forecast(logs, fut).orderBy("ds").collect()])
    assert np.abs(missed - truth).max() > 5.0
    # the band opens with the horizon
    width = [r["yhat_upper"] - r["yhat_lower"] for r in rows]
    assert width[-1] > width[0] or not any(model.params.first()["coef"][2:7])


def test_fit_without_keys_equals_the_grouped_fit(spark):
    hist = _history(spark, n=500, keys=("a",)).repartition(5)
    for spec in (FC.SICK_SPEC, FC.CALLS_SPEC):
        h = FC.regressor_frame(hist, "y", spec.regressors, ["series"])
        grouped = FC.fit_forecast(h, spec, ["series"])
        alone = FC.fit_forecast(h.drop("series"), spec)
        fut = h.drop("y")
        a = [r["yhat"] for r in FC.predict_forecast(grouped, fut).orderBy("ds").collect()]
        b = [r["yhat"] for r in FC.predict_forecast(alone, fut.drop("series")).orderBy("ds").collect()]
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    assert "_g" not in alone.params.columns


def test_moments_are_summed_in_groups_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(FC, "MOMENT_GROUPS", 2)
    rng = np.random.default_rng(8)
    X, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    spec = FC.ForecastSpec(n_changepoints=1, seasonalities=(), regressors=())
    df = spark.createDataFrame([(x.tolist(), float(v)) for x, v in zip(X, y)], "_x array<double>, _ys double").repartition(7)
    coef = np.array([0.1, 0.2, 0.3])
    Z = FC.linearised(X, y, coef, spec)
    for grouped in (False, True):
        m = FC.summed_moments(df, spec, coef, grouped)
        assert np.allclose(m.gram, (Z.T @ Z)[:-2, :-2]) and np.isclose(m.sse, (Z.T @ Z)[-1, -1]) and m.n == 60


def test_empty_and_constant_histories(spark):
    empty = spark.createDataFrame([], "ds date, y double")
    spec = FC.ForecastSpec(n_changepoints=3, seasonalities=())
    assert FC.predict_forecast(FC.fit_forecast(empty, spec), empty.select("ds")).count() == 0
    flat = spark.createDataFrame([(x, 0.0) for x in days("2019-01-01", 30)], "ds date, y double")
    for mode in ("additive", "multiplicative"):
        s = FC.ForecastSpec(mode=mode, n_changepoints=3)
        assert all(abs(r["yhat"]) < 1e-6 for r in FC.predict_forecast(FC.fit_forecast(flat, s), flat.select("ds")).collect())
