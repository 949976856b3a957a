"""Registered queries on given forecasts, and fits that have a closed form SQL can state.

Forecasts and learners have no SQL equivalent in general.  Their surroundings
(regressor frames, trend bases, input tables, metrics) are checked with the
stand-in forecast ``0.25 · calls``, and the fitting machinery itself on the cases
with a closed form: a straight line with priors, and ordinary least squares on
one feature through persistence, cross-validation and the learning curve.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rostercast.operators import evaluate as V
from rostercast.operators import explore as X
from rostercast.operators import forecast as FC
from rostercast.operators import learn as L
from rostercast.plans import monthly as M
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import HOLDOUT, SEGMENT, TRAIN_END, modeling, register, round4, sql_standin, standin, with_sql
from rostercast.session import cut_lineage, ensure_checkpoint_dir
from rostercast.sources.driver_tables import daily_ops
from rostercast.sources.files import read_table, write_table

TRAIN = f"date <= DATE '{TRAIN_END}'"
IN_HOLDOUT = f"date BETWEEN DATE '{HOLDOUT[0]}' AND DATE '{HOLDOUT[1]}'"
SQL_HOLDOUT = IN_HOLDOUT


# --- F1, P3: regressor frame ---------------------------------------------------------------------------

@register("f1_regressor_frame", with_sql(S.modeling_ctes(SEGMENT)) + f"""
SELECT series, date AS ds, calls AS y, holiday, month, season, day_of_week, year,
  {S.week_of_month_expr('date')} AS week_of_month FROM modeling""")
def q_regressor_frame(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, segment=True, extended=True, columns=["calls"])
    return FC.regressor_frame(m, "calls", FC.CALLS_SPEC.regressors, ["series"])


# --- F6: scaled time and hinges ------------------------------------------------------------------------

@register("f6_trend_basis", with_sql(S.daily_cte(SEGMENT), f"""h AS (SELECT series, date,
  row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY series) AS n
  FROM daily WHERE date <= DATE '{TRAIN_END}')""",
                                     """b AS (SELECT series, min(date) AS d0,
  greatest(CAST(date_diff('day', min(date), max(date)) AS DOUBLE), 1.0) AS span FROM h GROUP BY series)""",
                                     """p AS (SELECT DISTINCT series,
  CAST(round_even(j * ((floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) - 1) / CAST(25 AS DOUBLE)), 0) AS BIGINT) AS pos
  FROM (SELECT DISTINCT series, n FROM h) c, range(1, 26) r(j) WHERE floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) > 1)""",
                                     """cp AS (SELECT h.series, row_number() OVER (PARTITION BY h.series ORDER BY h.date) AS j,
  date_diff('day', b.d0, h.date) / b.span AS tj FROM h JOIN p ON p.series = h.series AND p.pos = h.pos JOIN b ON b.series = h.series)""",
                                     """tt AS (SELECT d.series, d.date, date_diff('day', b.d0, d.date) / b.span AS t
  FROM daily d JOIN b ON b.series = d.series)""") + """
SELECT tt.series, tt.date AS ds, ROUND(any_value(tt.t), 4) AS t, ROUND(sum(greatest(tt.t - cp.tj, 0)), 4) AS hinges,
  ROUND(sum(cp.j * greatest(tt.t - cp.tj, 0)), 4) AS weighted_hinges
FROM tt JOIN cp ON cp.series = tt.series GROUP BY tt.series, tt.date""")
def q_trend_basis(spark: SparkSession, sf_dir: str):
    days = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=[]))
    history = days.where(TRAIN).withColumnRenamed("date", "ds")
    basis = FC.trend_basis(days.withColumnRenamed("date", "ds"), history, ["series"])
    hinges = [F.col(f"cp_{j}") for j in range(1, 26)]
    return round4(basis.select("series", "ds", "t", sum(hinges[1:], hinges[0]).alias("hinges"),
                               sum((j * h for j, h in enumerate(hinges[1:], 2)), hinges[0]).alias("weighted_hinges")))


# --- F8, J1, P5, P12: model inputs from given forecasts -----------------------------------------------

@register("f8_given_inputs", with_sql(S.modeling_ctes(SEGMENT), f"""last AS (SELECT series, max(date) AS d FROM modeling
  WHERE date <= DATE '{TRAIN_END}' GROUP BY series)""", f"""duty AS (SELECT m.series, CAST(round(avg(n_duty)) AS INTEGER) AS n_duty
  FROM modeling m JOIN last l ON l.series = m.series WHERE m.date <= DATE '{TRAIN_END}' AND m.date > l.d - {M.RECENT_DAYS} GROUP BY m.series)""") + f"""
SELECT m.series, m.date, CAST(trunc({sql_standin('calls')}) AS INTEGER) AS calls, CAST(trunc({sql_standin('n_sick')}) AS INTEGER) AS n_sick,
  CAST(year(m.date) AS INTEGER) AS year, d.n_duty FROM modeling m JOIN duty d ON d.series = m.series WHERE {SQL_HOLDOUT}""")
def q_given_inputs(spark: SparkSession, sf_dir: str):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, columns=["calls", "n_sick", "n_duty"]))
    given = m.where(IN_HOLDOUT).withColumnRenamed("date", "ds")
    calls, sick = (given.select("series", "ds", standin(c).alias("yhat")) for c in ("calls", "n_sick"))
    return FC.combine_inputs(calls, sick, ["series"], M.recent_duty(m.where(TRAIN), ["series"]))


# --- F9, A4, V2: metrics of a given forecast --------------------------------------------------------------

@register("f9_given_metrics", with_sql(S.modeling_ctes(SEGMENT), f"""e AS (SELECT series, CAST(n_sick AS DOUBLE) AS y, {sql_standin('calls')} AS p
  FROM modeling WHERE {SQL_HOLDOUT})""") + """
SELECT series, count(*) AS n, ROUND(avg((y - p) * (y - p)), 4) AS mse, ROUND(avg(abs(y - p)), 4) AS mae,
  ROUND(avg(y / NULLIF(p, 0)), 4) AS mean_ratio, ROUND(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM e GROUP BY series""")
def q_given_metrics(spark: SparkSession, sf_dir: str):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, columns=["calls", "n_sick"]))
    forecast = m.where(IN_HOLDOUT).select("series", F.col("date").alias("ds"), standin().alias("yhat"))
    return round4(FC.forecast_metrics(FC.regressor_frame(m, "n_sick", (), ["series"]), forecast, ["series"]))


# --- F7, F4: a straight line with its prior, in closed form -----------------------------------------------

LINE = FC.ForecastSpec(n_changepoints=0, seasonalities=(), regressors=())


def _line_step(src: str, out: str, noise: str) -> str:
    """One solve of the 2 × 2 normal equations with the slope's penalty ``noise / 25``."""
    stt = f"(stt + {noise} / 25.0)"
    return f"""{out} AS (SELECT *, (sty - st * sy / n) / ({stt} - st * st / n) AS b,
  (sy - st * (sty - st * sy / n) / ({stt} - st * st / n)) / n AS a FROM {src})"""


@register("f7_line_fit", with_sql(S.daily_cte(SEGMENT), f"""h AS (SELECT * FROM daily WHERE date <= DATE '{TRAIN_END}')""",
                                  """g AS (SELECT series, min(date) AS d0,
  greatest(CAST(date_diff('day', min(date), max(date)) AS DOUBLE), 1.0) AS span, CAST(max(calls) AS DOUBLE) AS top FROM h GROUP BY series)""",
                                  """x AS (SELECT h.series, date_diff('day', d0, date) / span AS t, calls / top AS y FROM h JOIN g ON g.series = h.series)""",
                                  """s AS (SELECT series, CAST(count(*) AS DOUBLE) AS n, sum(t) AS st, sum(t * t) AS stt, sum(y) AS sy, sum(t * y) AS sty
  FROM x GROUP BY series)""", _line_step("s", "one", "0.01"),
                                  """r AS (SELECT one.series, n, st, stt, sy, sty, v.v AS noise FROM one JOIN (SELECT x.series,
  greatest(avg((y - a - b * t) * (y - a - b * t)), 1e-12) AS v FROM x JOIN one o ON o.series = x.series GROUP BY x.series) v ON v.series = one.series)""",
                                  _line_step("r", "two", "noise")) + f"""
SELECT d.series, d.date AS ds, ROUND((two.a + two.b * date_diff('day', g.d0, d.date) / g.span) * g.top, 4) AS yhat
FROM daily d JOIN g ON g.series = d.series JOIN two ON two.series = d.series WHERE {SQL_HOLDOUT}""")
def q_line_fit(spark: SparkSession, sf_dir: str):
    days = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=["calls"]))
    model = FC.fit_forecast(FC.regressor_frame(days.where(TRAIN), "calls", (), ["series"]), LINE, ["series"])
    future = days.where(IN_HOLDOUT).select("series", F.col("date").alias("ds"))
    return round4(FC.predict_forecast(model, future).select("series", "ds", "yhat"))


# --- R13: forecast against actual ---------------------------------------------------------------------------

@register("r13_given_forecast", with_sql(S.modeling_ctes(SEGMENT)) + f"""
SELECT series, date AS ds, ROUND({sql_standin()}, 4) AS yhat, CAST(n_sick AS DOUBLE) AS actual,
  ROUND(n_sick - {sql_standin()}, 4) AS residual FROM modeling WHERE {SQL_HOLDOUT}""")
def q_given_forecast(spark: SparkSession, sf_dir: str):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, columns=["calls", "n_sick"])).where(IN_HOLDOUT)
    forecast = m.select("series", F.col("date").alias("ds"), standin().alias("yhat"))
    actual = m.select("series", F.col("date").alias("ds"), F.col("n_sick").cast("double").alias("actual"))
    out = forecast.join(actual, ["series", "ds"], "left")
    return round4(V.residual_table(out, "actual", "yhat", ["series"], order_col="ds")
                  .select("series", "ds", F.col("y_pred").alias("yhat"), F.col("y").alias("actual"), "residual"))


# --- D5: the last days as test set -----------------------------------------------------------------------

@register("v3_chrono_split", with_sql(S.daily_cte(SEGMENT)) + """
SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date DESC)
  <= ceil(count(*) OVER (PARTITION BY series) * CAST(0.2 AS DOUBLE)) AS is_test FROM daily""")
def q_chrono_split(spark: SparkSession, sf_dir: str):
    days = daily_ops(spark, sf_dir, SEGMENT, columns=[]).select("series", "date")
    return V.chrono_split(days, keys=["series"])


# --- S2, S4: written with the key first, read again ----------------------------------------------------------

@register("s2_table_roundtrip", with_sql(S.modeling_ctes(SEGMENT)) + """
SELECT date, series, calls, n_sick, 'date' AS first_column FROM modeling""")
def q_table_roundtrip(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, segment=True, columns=["calls", "n_sick"]).select("series", "date", "calls", "n_sick")
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    write_table(m, path, key_first="date")
    again = read_table(spark, path)
    return again.withColumn("first_column", F.lit(again.columns[0]))


# --- S5, S6, L9, V8: least squares on one feature ------------------------------------------------------------

SPLIT_SQL = f"""sp AS (SELECT *, substr(md5(strftime(date, '%Y-%m-%d') || '|42'), 1, 8) < '33333333' AS is_test FROM modeling
  WHERE date <= DATE '{TRAIN_END}')"""
FOLDS_SQL = """tr AS (SELECT date, CAST(calls AS DOUBLE) AS x, CAST(sby_need AS DOUBLE) AS y,
  ntile(5) OVER (ORDER BY date) - 1 AS fold, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM sp WHERE NOT is_test)"""


def _split(spark: SparkSession, sf_dir: str):
    m = cut_lineage(V.hash_split(modeling(spark, sf_dir, columns=["calls", "sby_need", "n_sby"]).where(TRAIN), ["date"]))
    return m.where(~F.col("is_test")), m.where(F.col("is_test"))


@register("s5_ols_roundtrip", with_sql(S.modeling_ctes(), SPLIT_SQL, """co AS (SELECT regr_slope(sby_need, calls) AS b,
  regr_intercept(sby_need, calls) AS a FROM sp WHERE NOT is_test)""") + """
SELECT date, calls, sby_need, ROUND(a + b * calls, 4) AS prediction FROM sp, co WHERE is_test""")
def q_ols_roundtrip(spark: SparkSession, sf_dir: str):
    train, test = _split(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    L.save_model(L.fit(train, ["calls"], L.linear_baseline()), path)
    return round4(L.score(L.load_model(path), test).select("date", "calls", "sby_need", "prediction"))


@register("l9_ols_cv", with_sql(S.modeling_ctes(), SPLIT_SQL, FOLDS_SQL,
                                """co AS (SELECT f.fold, regr_slope(tr.y, tr.x) AS b, regr_intercept(tr.y, tr.x) AS a
  FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold GROUP BY f.fold)""",
                                """err AS (SELECT tr.fold, avg((tr.y - a - b * tr.x) * (tr.y - a - b * tr.x)) AS mse
  FROM tr JOIN co ON co.fold = tr.fold GROUP BY tr.fold)""") + """
SELECT 'regParam=0.0' AS point, ROUND(avg(mse), 4) AS cv_mse FROM err""")
def q_ols_cv(spark: SparkSession, sf_dir: str):
    train, _ = _split(spark, sf_dir)
    least = L.Candidate("least squares", lambda **kw: L.linear_baseline().setParams(**kw), {}, {"regParam": [0.0]})
    _, _, metrics = L.grid_search(train, ["calls"], least)
    return round4(spark.createDataFrame([(f"regParam={p['regParam']}", m) for p, m in zip(L.grid_points(least.grid), metrics)],
                                        "point string, cv_mse double"))


@register("v8_ols_curve", with_sql(S.modeling_ctes(), SPLIT_SQL, FOLDS_SQL, """most AS (SELECT max(n) - CAST(ceil(max(n) / 5.0) AS BIGINT) AS m FROM tr)""",
                                   """sz AS (SELECT DISTINCT least(greatest(CAST(trunc(f * m) AS BIGINT), 1), m) AS size
  FROM most, (SELECT CAST(0.1 AS DOUBLE) + i * (CAST(1.0 AS DOUBLE) - CAST(0.1 AS DOUBLE)) / 4 AS f FROM range(4) r(i) UNION ALL SELECT CAST(1.0 AS DOUBLE)))""",
                                   """oth AS (SELECT f.fold AS held, tr.x, tr.y, row_number() OVER (PARTITION BY f.fold ORDER BY tr.pos) AS k
  FROM (SELECT DISTINCT fold FROM tr) f JOIN tr ON tr.fold <> f.fold)""",
                                   """co AS (SELECT size, held, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM sz JOIN oth ON oth.k <= sz.size GROUP BY size, held)""",
                                   """ex1 AS (SELECT c.size, c.held, avg((y - a - b * x) * (y - a - b * x)) AS mse FROM co c JOIN oth o ON o.held = c.held AND o.k <= c.size
  GROUP BY c.size, c.held)""",
                                   """ex2 AS (SELECT c.size, c.held, avg((y - a - b * x) * (y - a - b * x)) AS mse FROM co c JOIN tr ON tr.fold = c.held
  GROUP BY c.size, c.held)""") + """
SELECT CAST(ex1.size AS INTEGER) AS train_size, ROUND(avg(ex1.mse), 4) AS train_mse, ROUND(avg(ex2.mse), 4) AS val_mse
FROM ex1 JOIN ex2 ON ex2.size = ex1.size AND ex2.held = ex1.held GROUP BY ex1.size""")
def q_ols_curve(spark: SparkSession, sf_dir: str):
    train, _ = _split(spark, sf_dir)
    return round4(L.learning_curve(spark, train, ["calls"], L.linear_baseline))


# --- J2: truth against given predictions, day by day ------------------------------------------------------------

@register("j2_given_comparison", with_sql(S.modeling_ctes(SEGMENT), f"""e AS (SELECT series, CAST(sby_need AS DOUBLE) AS y, {sql_standin('n_sick')} AS p
  FROM modeling WHERE {SQL_HOLDOUT})""") + """
SELECT series, count(*) AS n, ROUND(avg(abs(y - p)), 4) AS mae, ROUND(avg((y - p) * (y - p)), 4) AS mse, ROUND(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
  ROUND(CASE WHEN var_pop(y) > 0 THEN 1 - avg((y - p) * (y - p)) / var_pop(y) WHEN avg((y - p) * (y - p)) = 0 THEN 1 ELSE 0 END, 4) AS r2 FROM e GROUP BY series""")
def q_given_comparison(spark: SparkSession, sf_dir: str):
    m = cut_lineage(modeling(spark, sf_dir, segment=True, columns=["sby_need", "n_sick", "n_sby"]).where(IN_HOLDOUT))
    given = m.select("series", "date", standin("n_sick").alias("prediction"))
    return round4(V.matched_metrics(m.withColumnRenamed("sby_need", "y"), given, ["series"]))


# --- U1, O1, L10, O3: candidates given by their predictions ------------------------------------------------------

# model, number of features, variant, factor of the stand-in prediction (the third and fourth tie)
GIVEN = [("a", 1, "default", 0.020), ("a", 1, "tuned", 0.024), ("a", 2, "default", 0.026), ("a", 3, "tuned", 0.026),
         ("b", 1, "default", 0.030), ("b", 2, "default", 0.028), ("b", 2, "tuned", 0.028)]


@register("l10_given_selection", with_sql(S.modeling_ctes(), "c AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {n}, '{v}', CAST({f} AS DOUBLE))" for m, n, v, f in GIVEN) + ") t(model, n_features, variant, factor))",
    f"""met AS (SELECT c.model, c.n_features, c.variant, count(*) AS n, avg(abs(sby_need - calls * factor)) AS mae, avg(power(sby_need - calls * factor, 2)) AS mse
  FROM modeling, c WHERE {TRAIN} GROUP BY ALL)""",
    """best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mse, n_features, CASE WHEN variant = 'default' THEN 0 ELSE 1 END) = 1 AS is_best,
  row_number() OVER (ORDER BY mse, model, n_features, variant) AS place FROM met)""") + """
SELECT model, CAST(n_features AS INTEGER) AS n_features, variant, n, ROUND(mae, 4) AS mae, ROUND(mse, 4) AS mse, is_best,
  model || ' (' || n_features || ' features)' AS key, CAST(place AS INTEGER) AS place FROM best""")
def q_given_selection(spark: SparkSession, sf_dir: str):
    """Metric rows of given predictions, stacked, ranked by error, the best candidate of each model marked."""
    m = cut_lineage(modeling(spark, sf_dir, columns=["calls", "sby_need", "n_sby"]).where(TRAIN))
    rows = {}
    for i, (_, _, _, factor) in enumerate(GIVEN):
        given = m.select("date", F.col("sby_need").alias("y"), (F.col("calls") * F.lit(factor)).alias("prediction"))
        rows[str(i)] = V.regression_metrics(given)
    named = F.array(*[F.struct(F.lit(a).alias("model"), F.lit(n).alias("n_features"), F.lit(v).alias("variant")) for a, n, v, _ in GIVEN])
    stacked = L.stack_results(rows).withColumn("c", F.get(named, F.col("model").cast("int"))).drop("model").select("c.*", "n", "mae", "mse")
    marked = L.mark_best(stacked, "mse")
    ranked = V.best_per_group(marked, [], ["mse", "model", "n_features", "variant"], "place")
    return round4(ranked.select("model", "n_features", "variant", "n", "mae", "mse", "is_best", "key", "place"))


# --- O1, O2, L8: given importances ---------------------------------------------------------------------------------

@register("o2_given_importance", with_sql(S.modeling_ctes(), "i AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, sby_need)) AS importance FROM modeling WHERE {TRAIN}" for c in ("calls", "month", "n_sick", "week", "year")) + ")") + """
SELECT feature, ROUND(importance, 4) AS importance, CAST(row_number() OVER (ORDER BY importance DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM i QUALIFY rank <= 3""")
def q_given_importance(spark: SparkSession, sf_dir: str):
    """The three features most correlated with the target, through the ranking and the selection of the model search."""
    names = ["calls", "month", "n_sick", "week", "year"]
    m = modeling(spark, sf_dir, columns=["calls", "sby_need", "n_sick", "n_sby"]).where(TRAIN)
    given = X.corr_long(m, [*names, "sby_need"]).where("y = 'sby_need' and x <> 'sby_need'").select(F.col("x").alias("feature"), F.abs("r").alias("importance"))
    ranked = cut_lineage(L.rank_importances(given))
    return round4(ranked.where(F.col("feature").isin(L.top_features(ranked, 3))))


# --- P16, L1, L12: least squares on all features, by the normal equations -----------------------------------------

def _least_squares(features: list[str], rows: str, key: str = "date") -> list[str]:
    """``co``: standardised means, deviations and coefficients (intercept first), by Gauss-Jordan elimination."""
    n = len(features) + 1
    z = ["CAST(1 AS DOUBLE)", *[f"(({f} - mu[{i + 1}]) / sd[{i + 1}])" for i, f in enumerate(features)]]
    sums = ", ".join("[" + ", ".join([f"sum({a} * {b})" for b in z] + [f"sum({a} * sby_need)"]) + "]" for a in z)
    return [f"st AS (SELECT [{', '.join(f'avg({f})' for f in features)}] AS mu, [{', '.join(f'stddev_samp({f})' for f in features)}] AS sd FROM {rows})",
            f"m0 AS (SELECT [{sums}] AS m FROM {rows}, st)",
            f"""el AS (SELECT 1 AS k, m FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
  THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= {n})""",
            f"co AS (SELECT list_transform(m, lambda r: r[{n + 1}]) AS b, mu, sd FROM el, st WHERE k = {n + 1})"]


def _fitted(features: list[str]) -> str:
    return "b[1] + " + " + ".join(f"b[{i + 2}] * ({f} - mu[{i + 1}]) / sd[{i + 1}]" for i, f in enumerate(features))


EXTENDED = f"x AS (SELECT *, CAST(day(date) AS INTEGER) AS day, {S.week_of_month_expr('date')} AS week_of_month FROM modeling)"


@register("p16_least_squares", "WITH RECURSIVE " + ",\n".join([
    S.modeling_ctes(), EXTENDED, f"""sp AS (SELECT *, substr(md5(strftime(date, '%Y-%m-%d') || '|42'), 1, 8) < '33333333' AS is_test FROM x WHERE {TRAIN})""",
    "tr AS (SELECT * FROM sp WHERE NOT is_test)", *_least_squares(L.ALL_FEATURES, "tr")]) + f"""
SELECT date, ROUND({_fitted(L.ALL_FEATURES)}, 4) AS prediction FROM sp, co WHERE is_test""")
def q_least_squares(spark: SparkSession, sf_dir: str):
    """The linear baseline on the fixed list of 11 features, standardised: test predictions."""
    m = cut_lineage(V.hash_split(modeling(spark, sf_dir, extended=True).where(TRAIN), ["date"]))
    model = L.fit(m.where("not is_test"), L.ALL_FEATURES, L.linear_baseline())
    return round4(L.score(model, m.where("is_test")).select("date", "prediction"))


@register("l12_full_training", "WITH RECURSIVE " + ",\n".join([
    S.modeling_ctes(SEGMENT), "tr AS (SELECT * FROM modeling WHERE date <= (SELECT CAST(date_trunc('month', max(date)) AS DATE) + 13 FROM modeling))",
    *_least_squares(L.PROD_FEATURES, "tr")]) + f"""
SELECT series, date, ROUND({_fitted(L.PROD_FEATURES)}, 4) AS prediction FROM modeling, co""")
def q_full_training(spark: SparkSession, sf_dir: str):
    """The production pipeline with a least-squares learner, trained on every row up to the dynamic cut-off, on all days."""
    m = cut_lineage(modeling(spark, sf_dir, segment=True))
    model = M.train_full(m, ["series"], estimator=L.linear_baseline())
    return round4(L.score(model, m).select("series", "date", "prediction"))
