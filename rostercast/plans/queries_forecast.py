"""Registered queries on the forecast's core: sparse trend changes, the band, the multiplicative mode, the fit without keys.

Each has a case that SQL states in closed form or by a short recursion over moments; the sparse trend
with all its changes is held against the optimality conditions of its L1 problem.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.functions.scalars import attach_scalars
from rostercast.operators import forecast as FC
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import HOLDOUT, SEGMENT, TRAIN_END, modeling, register, round4, with_sql
from rostercast.session import cut_lineage
from rostercast.sources.driver_tables import daily_ops

TRAIN = f"date <= DATE '{TRAIN_END}'"
IN_HOLDOUT = f"date BETWEEN DATE '{HOLDOUT[0]}' AND DATE '{HOLDOUT[1]}'"


def _scaled_ctes(n_changepoints: int, key: str = "series, ") -> list[str]:
    """``x``: scaled time t and value y of the training days; ``g``: first day, span and top; ``cps``: changepoints (j, tj)."""
    part = "PARTITION BY series " if key else ""
    on = "USING (series)" if key else "ON true"
    group = "GROUP BY series" if key else ""
    return [f"h AS (SELECT *, row_number() OVER ({part}ORDER BY date) - 1 AS pos, count(*) OVER ({part.strip()}) AS n FROM daily WHERE {TRAIN})",
            f"""g AS (SELECT {key}min(date) AS d0, greatest(CAST(date_diff('day', min(date), max(date)) AS DOUBLE), 1.0) AS span,
  CAST(max(calls) AS DOUBLE) AS top FROM h {group})""",
            f"""p AS (SELECT DISTINCT {key}CAST(round_even(j * ((floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) - 1) / CAST({n_changepoints} AS DOUBLE)), 0) AS BIGINT) AS pos
  FROM (SELECT DISTINCT {key}n FROM h) c, range(1, {n_changepoints + 1}) r(j) WHERE floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) > 1)""",
            f"""cps AS (SELECT {key}row_number() OVER ({part}ORDER BY date) AS j, date_diff('day', d0, date) / span AS tj
  FROM h JOIN p USING ({key}pos) JOIN g {on})""",
            f"x AS (SELECT {key}date_diff('day', d0, date) / span AS t, calls / top AS y FROM h JOIN g {on})"]


# --- F7, F3, F4: one trend change, in closed form with its band ----------------------------------------------

ONE_CHANGE = FC.ForecastSpec(n_changepoints=1, changepoint_prior_scale=0.05, seasonalities=(), regressors=(), interval_width=0.95)


def _one_change_step(src: str, out: str, noise: str) -> str:
    """Intercept, slope (Gaussian prior) and one hinge (Laplace prior): the hinge by soft thresholding."""
    bent = f"(shh - sth * sth / (stt + {noise} / 25.0))"
    pull = f"(shy - sth * sty / (stt + {noise} / 25.0))"
    return f"""{out}0 AS (SELECT *, sign({pull}) * greatest(abs({pull}) - {noise} / 0.05, 0) / {bent} AS d FROM {src}),
{out} AS (SELECT *, (sty - sth * d) / (stt + {noise} / 25.0) AS b, my - mt * (sty - sth * d) / (stt + {noise} / 25.0) - mh * d AS a FROM {out}0)"""


def _residual_step(src: str, out: str, keep: str) -> str:
    return f"""{out} AS (SELECT s.*, v.noise FROM s JOIN (SELECT series, greatest(avg((y - a - b * t - d * h) * (y - a - b * t - d * h)), 1e-12) AS noise
  FROM xh JOIN (SELECT series, a, b, d FROM {src}) q USING (series) GROUP BY series) v USING (series))"""


@register("f4_one_change_band", with_sql(
    S.daily_cte(SEGMENT), *_scaled_ctes(1), "xh AS (SELECT series, t, y, greatest(t - tj, 0) AS h FROM x JOIN cps USING (series))",
    """s AS (SELECT series, avg(t) AS mt, avg(h) AS mh, avg(y) AS my, covar_pop(t, t) * count(*) AS stt, covar_pop(t, h) * count(*) AS sth,
  covar_pop(h, h) * count(*) AS shh, covar_pop(t, y) * count(*) AS sty, covar_pop(h, y) * count(*) AS shy FROM xh GROUP BY series)""",
    _one_change_step("s", "one", "0.01"), _residual_step("one", "s2", ""), _one_change_step("s2", "two", "noise"),
    _residual_step("two", "s3", ""),
    f"""f AS (SELECT series, date AS ds, top, date_diff('day', d0, date) / span AS t, tj FROM daily JOIN g USING (series) JOIN cps USING (series) WHERE {IN_HOLDOUT})""",
    f"""z AS (SELECT f.series, ds, top, a + b * t + d * greatest(t - tj, 0) AS m,
  {NormalDist().inv_cdf(0.975)!r} * sqrt(s3.noise + 2 * d * d * power(greatest(t - 1, 0), 3) / 3) AS half
  FROM f JOIN two USING (series) JOIN (SELECT series, noise FROM s3) s3 USING (series))""") + """
SELECT series, ds, ROUND(m * top, 4) AS yhat, ROUND((m - half) * top, 4) AS yhat_lower, ROUND((m + half) * top, 4) AS yhat_upper FROM z""")
def q_one_change_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and band of a trend with one possible change, per segment, on the holdout days."""
    days = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=["calls"]))
    model = FC.fit_forecast(FC.regressor_frame(days.where(TRAIN), "calls", (), ["series"]), ONE_CHANGE, ["series"])
    return round4(FC.predict_forecast(model, days.where(IN_HOLDOUT).select("series", F.col("date").alias("ds"))))


# --- F7: 25 trend changes, optimality of the L1 solution -------------------------------------------------------

SPARSE = FC.ForecastSpec(changepoint_prior_scale=0.05, seasonalities=(), regressors=())


@register("f7_sparse_trend", with_sql(
    S.daily_cte(SEGMENT), *_scaled_ctes(25),
    """basis AS (SELECT series, t, y, 0 AS j, 1.0 AS v FROM x UNION ALL SELECT series, t, y, 1, t FROM x
  UNION ALL SELECT series, t, y, j + 1, greatest(t - tj, 0) FROM x JOIN cps USING (series))""") + """
SELECT series, CAST(j AS INTEGER) AS j, ROUND(sum(v * v), 4) AS xtx, ROUND(sum(v * y), 4) AS xty, true AS optimal
FROM basis GROUP BY series, j""")
def q_sparse_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the trend basis: its square sum, its product with y, and whether the fitted coefficients
    meet the optimality conditions there: the gradient equals the prior's slope, or for a
    change of exactly 0 does not exceed it."""
    days = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=["calls"]).where(TRAIN))
    history = FC.regressor_frame(days, "calls", (), ["series"])
    model = FC.fit_forecast(history, SPARSE, ["series"])
    basis = FC.trend_basis(history, history, ["series"])
    columns = F.array(F.lit(1.0), F.col("t"), *[F.col(f"cp_{j}") for j in range(1, 26)])
    rows = attach_scalars(basis.select("series", "y", columns.alias("x")), model.params.select("series", "coef", "noise_sd", "_yscale"), ["series"])
    rows = rows.select("series", "coef", "noise_sd", "x", (F.col("y") / F.col("_yscale")).alias("y"),
                       F.expr("y / _yscale - aggregate(zip_with(x, coef, (a, b) -> a * b), 0D, (s, v) -> s + v)").alias("e"))
    each = rows.select("series", "y", "e", "noise_sd", F.expr("inline(transform(x, (v, j) -> named_struct('j', j, 'v', v, 'b', coef[j])))"))
    sums = each.groupBy("series", "j", "b", "noise_sd").agg(
        F.sum(F.col("v") * F.col("v")).alias("xtx"), F.sum(F.col("v") * F.col("y")).alias("xty"), F.sum(F.col("v") * F.col("e")).alias("gradient"))
    noise = F.col("noise_sd") * F.col("noise_sd")
    slack = F.lit(1e-7) * (1 + F.abs("xty"))
    rule = (F.when(F.col("j") == 0, F.abs("gradient") <= slack)
            .when(F.col("j") == 1, F.abs(F.col("gradient") - F.col("b") * noise / 25.0) <= slack)
            .when(F.col("b") == 0, F.abs("gradient") <= noise / SPARSE.changepoint_prior_scale + slack)
            .otherwise(F.abs(F.col("gradient") - F.signum("b") * noise / SPARSE.changepoint_prior_scale) <= slack))
    return round4(sums.select("series", F.col("j").cast("int").alias("j"), "xtx", "xty", rule.alias("optimal")))


# --- F2: multiplicative mode, one trend and one factor, by moments ---------------------------------------------

FACTOR = FC.ForecastSpec(mode="multiplicative", n_changepoints=0, seasonalities=(), regressors=("season",))
ROUNDS = 40  # alternations of the SQL: trend given factor, factor given trend


def _alternation(start: str, out: str, noise: str) -> str:
    """Alternating least squares on moments: y = (a + b t)(1 + c w), priors N(0, 25) on b and N(0, 100) on c."""
    n0, n1, n2 = (f"(m{k}0 + 2 * c * m{k}1 + c * c * m{k}2)" for k in (0, 1, 2))  # sums of t^k (1 + c w)^2
    y0, y1 = "(y00 + c * y01)", "(y10 + c * y11)"
    det = f"({n0} * ({n2} + {noise} / 25.0) - {n1} * {n1})"
    a, b = f"(({y0} * ({n2} + {noise} / 25.0) - {y1} * {n1}) / {det})", f"(({y1} * {n0} - {y0} * {n1}) / {det})"
    # factor: regress y - g on g w
    c = f"((qa * y01 + qb * y11 - qa * qa * m01 - 2 * qa * qb * m11 - qb * qb * m21) / (qa * qa * m02 + 2 * qa * qb * m12 + qb * qb * m22 + {noise} / 100.0))"
    return f"""{out}_it AS (SELECT 0 AS k, {start}.*, CAST(0 AS DOUBLE) AS qa, CAST(0 AS DOUBLE) AS qb, CAST(0 AS DOUBLE) AS c FROM {start}
  UNION ALL SELECT k + 1, * EXCLUDE (k, qa, qb, c), qa, qb, {c} AS c FROM (SELECT * REPLACE ({a} AS qa, {b} AS qb) FROM {out}_it WHERE k < {ROUNDS})),
{out} AS (SELECT series, qa AS a, qb AS b, c FROM {out}_it WHERE k = {ROUNDS})"""


@register("f2_multiplicative", "WITH RECURSIVE " + ",\n".join([
    S.modeling_ctes(SEGMENT), f"h AS (SELECT * FROM modeling WHERE {TRAIN})",
    """g AS (SELECT series, min(date) AS d0, greatest(CAST(date_diff('day', min(date), max(date)) AS DOUBLE), 1.0) AS span, CAST(max(calls) AS DOUBLE) AS top,
  avg(season) AS mu, stddev_samp(season) AS sd FROM h GROUP BY series)""",
    "x AS (SELECT series, date_diff('day', d0, date) / span AS t, (season - mu) / sd AS w, calls / top AS y FROM h JOIN g USING (series))",
    "m AS (SELECT series, " + ", ".join(f"sum(power(t, {k}) * power(w, {j})) AS m{k}{j}" for k in range(3) for j in range(3))
    + ", " + ", ".join(f"sum(y * power(t, {k}) * power(w, {j})) AS y{k}{j}" for k in range(2) for j in range(2)) + ", CAST(0.01 AS DOUBLE) AS noise FROM x GROUP BY series)",
    _alternation("m", "one", "noise"),
    """m2 AS (SELECT m.* REPLACE (v.noise AS noise) FROM m JOIN (SELECT series, greatest(avg(power(y - (a + b * t) * (1 + c * w), 2)), 1e-12) AS noise
  FROM x JOIN one USING (series) GROUP BY series) v USING (series))""",
    _alternation("m2", "two", "noise")]) + f"""
SELECT d.series, d.date AS ds, ROUND((a + b * date_diff('day', d0, d.date) / span) * (1 + c * (d.season - mu) / sd) * top, 4) AS yhat
FROM modeling d JOIN g USING (series) JOIN two USING (series) WHERE {IN_HOLDOUT}""")
def q_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line times a factor of the season, per segment, on the holdout days."""
    m = cut_lineage(modeling(spark, sf_dir, segment=True, columns=["calls"]))
    model = FC.fit_forecast(FC.regressor_frame(m.where(TRAIN), "calls", FACTOR.regressors, ["series"]), FACTOR, ["series"])
    future = m.where(IN_HOLDOUT).select("series", F.col("date").alias("ds"), *FACTOR.regressors)
    return round4(FC.predict_forecast(model, future).select("series", "ds", "yhat"))


# --- F7: one series without keys, through distributed moments ---------------------------------------------------

LINE = FC.ForecastSpec(n_changepoints=0, seasonalities=(), regressors=())


def _line_step(src: str, out: str, noise: str) -> str:
    return f"{out} AS (SELECT *, my - mt * sty / (stt + {noise} / 25.0) AS a, sty / (stt + {noise} / 25.0) AS b FROM {src})"


@register("f7_keyless_line", with_sql(
    S.daily_cte(), *[c for c in _scaled_ctes(1, "") if not c.startswith(("p AS", "cps AS"))],
    "s AS (SELECT avg(t) AS mt, avg(y) AS my, covar_pop(t, t) * count(*) AS stt, covar_pop(t, y) * count(*) AS sty FROM x)",
    _line_step("s", "one", "0.01"),
    "s2 AS (SELECT s.*, greatest((SELECT avg(power(y - a - b * t, 2)) FROM x, one), 1e-12) AS noise FROM s)", _line_step("s2", "two", "noise")) + f"""
SELECT date AS ds, ROUND((a + b * date_diff('day', d0, date) / span) * top, 4) AS yhat FROM daily, g, two WHERE {IN_HOLDOUT}""")
def q_keyless_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as one series: moments summed by all tasks, solved once."""
    days = cut_lineage(daily_ops(spark, sf_dir, columns=["calls"]))
    model = FC.fit_forecast(FC.regressor_frame(days.where(TRAIN), "calls", ()), LINE)
    return round4(FC.predict_forecast(model, days.where(IN_HOLDOUT).select(F.col("date").alias("ds"))).select("ds", "yhat"))
