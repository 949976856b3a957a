"""Registered queries: forecasting bases, forecasts, learners, search and the monthly roster."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rostercast.functions import calendar as cal
from rostercast.operators import evaluate as V
from rostercast.operators import forecast as FC
from rostercast.operators import learn as L
from rostercast.plans import monthly as M
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import HOLDOUT, SEGMENT, TRAIN_END, modeling, register, round4, with_sql
from rostercast.session import cut_lineage, ensure_checkpoint_dir, right_sized


def _train(m):
    return m.where(F.col("date") <= F.lit(TRAIN_END).cast("date"))


# --- F5: Fourier terms of the calls model -------------------------------------------------------------

def _fourier_sql() -> str:
    parts = []
    for s in FC.CALLS_SPEC.seasonalities:
        for k in range(1, s.order + 1):
            arg = f"(CAST({2.0 * 3.141592653589793 * k!r} AS DOUBLE) * CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE) / CAST({float(s.period)!r} AS DOUBLE))"
            parts.append(f"SELECT date, '{s.name}' AS component, {k} AS k, ROUND(sin({arg}), 4) + 0.0 AS sin, "
                         f"ROUND(cos({arg}), 4) + 0.0 AS cos FROM daily")
    return with_sql(S.daily_cte()) + "\n" + "\nUNION ALL\n".join(parts)


@register("f5_fourier", _fourier_sql())
def q_fourier(spark: SparkSession, sf_dir: str):
    from rostercast.sources.driver_tables import daily_ops
    d = daily_ops(spark, sf_dir, columns=[]).select("date")
    out = round4(FC.fourier_long(d, FC.CALLS_SPEC.seasonalities))
    return out.withColumns({"sin": F.col("sin") + F.lit(0.0), "cos": F.col("cos") + F.lit(0.0)})


# --- F6: changepoint candidates per segment -----------------------------------------------------------

@register("f6_changepoints", with_sql(S.daily_cte(SEGMENT), f"""h AS (SELECT series, date,
  row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n
  FROM daily WHERE date <= DATE '{TRAIN_END}')""", """p AS (SELECT DISTINCT series,
  CAST(round_even(j * ((floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) - 1) / CAST(25 AS DOUBLE)), 0) AS BIGINT) AS pos
  FROM (SELECT DISTINCT series, n FROM h) c, range(1, 26) r(j) WHERE floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) > 1)""")
          + "\nSELECT h.series, h.date AS cp_date FROM h JOIN p ON p.series = h.series AND p.pos = h.pos")
def q_changepoints(spark: SparkSession, sf_dir: str):
    from rostercast.sources.driver_tables import daily_ops
    d = _train(daily_ops(spark, sf_dir, SEGMENT, columns=[])).withColumnRenamed("date", "ds")
    cps = FC.changepoints(d, ["series"], "ds", 25, 0.8)
    return cps.select("series", F.explode("cp_dates").alias("cp_date"))


# --- C15/C16: future calendar frame per segment ---------------------------------------------------------

@register("c16_future_frame", with_sql(S.daily_cte(SEGMENT), """cut AS (SELECT DISTINCT series,
  CAST(date_trunc('month', max(date) OVER ()) AS DATE) + 13 AS cutoff FROM daily)""",
                                       """sp AS (SELECT series, CAST(unnest(generate_series(
  CAST(date_trunc('month', cutoff + INTERVAL 1 MONTH) AS DATE),
  CAST(last_day(cutoff + INTERVAL 1 MONTH) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM cut)""",
                                       S.easter_ctes("sp")) + f"""
SELECT t.series, t.date, {S.calendar_cols('t.date')}, {S.holiday_expr('t.date', 'e.easter')} AS holiday,
  CAST(day(t.date) AS INTEGER) AS day, {S.week_of_month_expr('t.date')} AS week_of_month
FROM sp t JOIN easter e ON e.y = year(t.date)""")
def q_future_frame(spark: SparkSession, sf_dir: str):
    from rostercast.sources.driver_tables import daily_ops
    days = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=[]).select("series", "date"))  # series and last date read it
    fut = M.future_frame(days, ["series"])
    return fut.select("series", "date", "day_of_week", "week", "month", "season", "year", "holiday", "day",
                      "week_of_month")


# --- F2, F3, F4, F9, A4: input forecasts on the holdout window -----------------------------------------

def _holdout_forecast(spark, sf_dir, target, spec):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, extended=True, columns=["calls", "n_sick"]))
    hist = FC.regressor_frame(_train(m), target, spec.regressors, ["series"])
    model = FC.fit_forecast(hist, spec, ["series"])
    bounds = m.select("series").distinct().select(
        "series", F.lit(HOLDOUT[0]).cast("date").alias("_s"), F.lit(HOLDOUT[1]).cast("date").alias("_e"))
    fut = cal.with_calendar(cal.date_spine(bounds, "_s", "_e", "ds"), "ds", extended=True)
    pred = FC.predict_forecast(model, fut.select("series", "ds", *spec.regressors))
    return m, pred


@register("f2_forecast_calls")
def q_forecast_calls(spark: SparkSession, sf_dir: str):
    _, pred = _holdout_forecast(spark, sf_dir, "calls", FC.CALLS_SPEC)
    return pred.select("series", "ds", "yhat", "yhat_lower", "yhat_upper")


@register("f3_forecast_sick")
def q_forecast_sick(spark: SparkSession, sf_dir: str):
    _, pred = _holdout_forecast(spark, sf_dir, "n_sick", FC.SICK_SPEC)
    return pred.select("series", "ds", "yhat", "yhat_lower", "yhat_upper")


@register("f9_forecast_metrics")
def q_forecast_metrics(spark: SparkSession, sf_dir: str):
    m, pred = _holdout_forecast(spark, sf_dir, "calls", FC.CALLS_SPEC)
    actual = FC.regressor_frame(m, "calls", (), ["series"])
    return FC.forecast_metrics(actual, pred, ["series"])


@register("f8_model_inputs")
def q_model_inputs(spark: SparkSession, sf_dir: str):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, extended=True, columns=["calls", "n_sick", "n_duty"]))
    cfg = M.RosterConfig()
    train = M.training_rows(m, ["series"])
    return M.forecast_inputs(train, M.future_frame(m, ["series"]), ["series"], cfg, integer_inputs=True)


# --- L1: linear baselines ---------------------------------------------------------------------------

def _split(spark, sf_dir):
    # fitted and scored several times: materialise the split table once
    m = right_sized(V.hash_split(_train(modeling(spark, sf_dir, extended=True)), ["date"]))
    return m.where(~F.col("is_test")), m.where(F.col("is_test"))


@register("l1_ols_one_feature", with_sql(S.modeling_ctes(), f"""sp AS (SELECT *,
  substr(md5(strftime(date, '%Y-%m-%d') || '|42'), 1, 8) < '33333333' AS is_test FROM modeling
  WHERE date <= DATE '{TRAIN_END}')""",
                                         """co AS (SELECT regr_slope(sby_need, calls) AS b, regr_intercept(sby_need, calls) AS a
  FROM sp WHERE NOT is_test)""",
                                         """pr AS (SELECT CAST(sby_need AS DOUBLE) AS y, a + b * calls AS p FROM sp, co WHERE is_test)""") + """
SELECT CAST(count(*) AS BIGINT) AS n, ROUND(avg(abs(y - p)), 4) AS mae, ROUND(avg((y - p) * (y - p)), 4) AS mse,
  ROUND(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
  ROUND(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2 FROM pr""")
def q_ols_one_feature(spark: SparkSession, sf_dir: str):
    train, test = _split(spark, sf_dir)
    model = L.fit(train, ["calls"], L.linear_baseline())
    return round4(V.regression_metrics(L.score(model, test), "sby_need", "prediction"))


@register("l1_linear_baseline")
def q_linear_baseline(spark: SparkSession, sf_dir: str):
    train, test = _split(spark, sf_dir)
    model = L.fit(train, L.ALL_FEATURES, L.linear_baseline())
    return V.regression_metrics(L.score(model, test), "sby_need", "prediction").withColumn("model", F.lit("baseline"))


# --- L7: importances --------------------------------------------------------------------------------

@register("l7_importance")
def q_importance(spark: SparkSession, sf_dir: str):
    train, _ = _split(spark, sf_dir)
    return L.importance(spark, train, L.ALL_FEATURES)


# --- L9, V8, L11: grid search, learning curve, model search --------------------------------------------

@register("l9_grid_search_reduced")
def q_grid_search(spark: SparkSession, sf_dir: str):
    train, _ = _split(spark, sf_dir)
    cand = L.CANDIDATES["Gradient Boosting Regressor"]
    grid = {"maxIter": [20], "stepSize": [0.1], "maxDepth": [3, 4]}
    _, best, metrics = L.grid_search(train, L.HOLDOUT_FEATURES, cand, grid=grid)
    pts = L.grid_points(grid)
    return spark.createDataFrame([(i, {k: str(v) for k, v in p.items()}, float(mv), p == {**p, **best})
                                  for i, (p, mv) in enumerate(zip(pts, metrics))],
                                 "point int, params map<string,string>, cv_mse double, is_best boolean")


@register("v8_learning_curve_reduced")
def q_learning_curve(spark: SparkSession, sf_dir: str):
    train, _ = _split(spark, sf_dir)
    return L.learning_curve(spark, train, L.HOLDOUT_FEATURES, lambda: L._gbt(maxIter=10, maxDepth=4, stepSize=0.1))


@register("l11_model_search_reduced")
def q_model_search(spark: SparkSession, sf_dir: str):
    """All five candidate profiles × two feature counts, default vs tuned for gradient
    boosting (reduced plan: 20 boosting rounds, 20 trees, a two-point grid)."""
    train, test = _split(spark, sf_dir)
    small = {"maxIter": 20}
    cfg = L.SearchConfig(
        feature_counts=[2, 4], tune=True, select_on="test",
        grids={"Gradient Boosting Regressor": {"maxDepth": [2, 3]}},
        defaults={"Random Forest Regressor": {"numTrees": 20, "maxDepth": 5},
                  "Gradient Boosting Regressor": {**L.CANDIDATES["Gradient Boosting Regressor"].defaults, **small},
                  "XGBoost Regressor": {**L.CANDIDATES["XGBoost Regressor"].defaults, **small},
                  "LightGBM Regressor": {**L.CANDIDATES["LightGBM Regressor"].defaults, **small},
                  "CatBoost Regressor": {**L.CANDIDATES["CatBoost Regressor"].defaults, **small}},
        importance_trees=20)
    return L.search(spark, train, test, cfg)


# --- S5/S6 + L12/L13: persistence round trip -----------------------------------------------------------

@register("s5_model_roundtrip")
def q_model_roundtrip(spark: SparkSession, sf_dir: str):
    train, test = _split(spark, sf_dir)
    model = L.fit(train, L.PROD_FEATURES, L._gbt(**L.PROD_PARAMS))
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    L.save_model(model, path)
    again = L.load_model(path)
    a = L.score(model, test).select("date", F.col("prediction").alias("p1"))
    b = L.score(again, test).select("date", F.col("prediction").alias("p2"))
    return a.join(b, "date").withColumn("same", F.col("p1") == F.col("p2"))


# --- entry points B and C ---------------------------------------------------------------------------

@register("b_holdout_evaluation")
def q_holdout_evaluation(spark: SparkSession, sf_dir: str):
    """Five scenario rows: the partial model on its test rows, and both models on the holdout, with true and with estimated inputs."""
    m = modeling(spark, sf_dir, extended=True)
    return M.holdout_evaluation(spark, m, TRAIN_END, HOLDOUT)["metrics"]


HOLDOUT_ROUNDS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1}  # the reports on a holdout frame, with fewer boosting rounds


@register("b_holdout_frame_reduced")
def q_holdout_frame(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, extended=True)
    return M.holdout_evaluation(spark, m, TRAIN_END, HOLDOUT, config=M.RosterConfig(model_params=HOLDOUT_ROUNDS), partial=False)["frame"]


@register("b_holdout_summary_reduced")
def q_holdout_summary(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, extended=True)
    return M.holdout_evaluation(spark, m, TRAIN_END, HOLDOUT, config=M.RosterConfig(model_params=HOLDOUT_ROUNDS), partial=False)["summary"]


@register("c_monthly_roster")
def q_monthly_roster(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, segment=True, extended=True)
    return M.monthly_roster(spark, m, ["series"], M.RosterConfig(floor=None))["predictions"]


@register("c_monthly_roster_weekly")
def q_monthly_roster_weekly(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, extended=True)
    return M.monthly_roster(spark, m, [], M.RosterConfig(floor=None))["weekly"]


# --- V2, R13: forecast fit on the training days; forecast vs actual with band ---------------------------

@register("v2_forecast_train_fit")
def q_forecast_train_fit(spark: SparkSession, sf_dir: str):
    m = _train(modeling(spark, sf_dir, segment=True, extended=True, columns=["calls"]))
    hist = cut_lineage(FC.regressor_frame(m, "calls", FC.CALLS_SPEC.regressors, ["series"]))
    model = FC.fit_forecast(hist, FC.CALLS_SPEC, ["series"])
    fitted = FC.predict_forecast(model, hist.drop("y"))
    return FC.forecast_metrics(hist, fitted, ["series"])


@register("r13_forecast_vs_actual")
def q_forecast_vs_actual(spark: SparkSession, sf_dir: str):
    m, pred = _holdout_forecast(spark, sf_dir, "n_sick", FC.SICK_SPEC)
    actual = m.select("series", F.col("date").alias("ds"), F.col("n_sick").cast("double").alias("actual"))
    return pred.select("series", "ds", "yhat", "yhat_lower", "yhat_upper").join(actual, ["series", "ds"], "left")


# --- entry point A: model search (reduced default plan; the full grid is opt-in) ------------------------

@register("a_model_search_reduced")
def q_a_model_search(spark: SparkSession, sf_dir: str):
    from rostercast.plans.search import model_search
    cfg = L.SearchConfig(models=["Random Forest Regressor", "Gradient Boosting Regressor"], feature_counts=[2, 4],
                         tune=False, select_on="test", defaults={"Random Forest Regressor": {"numTrees": 20, "maxDepth": 5},
                                               "Gradient Boosting Regressor": {"maxIter": 20, "maxDepth": 3,
                                                                               "stepSize": 0.1}},
                         importance_trees=20)
    out = model_search(spark, modeling(spark, sf_dir, extended=True), cfg, train_end=TRAIN_END, learning_curves=False)
    return out["results"]
