"""Registered queries: profiling, correlation, pivots, means, decomposition, splits, metrics."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rostercast.functions import calendar as cal
from rostercast.functions.roster import activation_rate
from rostercast.operators import evaluate as V
from rostercast.operators import explore as X
from rostercast.operators import profile as Q
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import SEGMENT, TRAIN_END, modeling, register, round4, sql_standin, standin, with_sql
from rostercast.session import cut_lineage
from rostercast.sources.driver_tables import daily_ops

MEASURES = ["calls", "n_sick", "sby_need"]
PANEL = ["n_sick", "calls", "n_duty", "dafted", "sby_need"]
NUMERIC = ["n_sick", "calls", "n_duty", "sby_need", "dafted", "activation_rate", "day_of_week", "week", "month",
           "season", "year", "holiday"]
RAW = ["date", "n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted"]
FEATURES = ["calls", "n_duty", "year", "n_sick"]


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- Q1-Q6: profiling ------------------------------------------------------------------------------

@register("q1_preview", with_sql(S.modeling_ctes()) + """
SELECT date, n_sick, calls, n_duty, sby_need, dafted, ROUND(activation_rate, 4) AS activation_rate, day_of_week,
  week, month, season, year, holiday FROM modeling ORDER BY date LIMIT 5""")
def q_preview(spark: SparkSession, sf_dir: str):
    return round4(Q.preview(modeling(spark, sf_dir), 5, "date"))


@register("q2_columns_report", with_sql(S.daily_cte()) + "\n" + _union([
    f"SELECT '{c}' AS column, {i} AS position, '{'date' if c == 'date' else 'bigint'}' AS dtype, "
    f"count({c}) AS non_null, count(*) - count({c}) AS nulls, count(*) AS rows, {len(RAW)} AS n_columns FROM daily"
    for i, c in enumerate(RAW)]))
def q_columns_report(spark: SparkSession, sf_dir: str):
    r = Q.columns_report(daily_ops(spark, sf_dir))
    return r.select("column", F.col("position").cast("int").alias("position"), "dtype", "non_null", "nulls", "rows",
                    F.col("n_columns").cast("int").alias("n_columns"))


@register("q5_distinct_report", with_sql(S.daily_cte()) + "\n" + _union([
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM daily" for c in RAW]))
def q_distinct_report(spark: SparkSession, sf_dir: str):
    return Q.distinct_report(daily_ops(spark, sf_dir))


def _describe_sql(keys: bool) -> str:
    cols = ["n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted", "activation_rate"]
    k = "series, " if keys else ""
    g = "GROUP BY series" if keys else ""
    parts = [f"""SELECT {k}'{c}' AS column, count({c}) AS count, ROUND(avg({c}), 4) AS mean,
  ROUND(stddev_samp({c}), 4) AS std, ROUND(CAST(min({c}) AS DOUBLE), 4) AS min,
  ROUND(quantile_cont({c}, 0.25), 4) AS p25, ROUND(quantile_cont({c}, 0.5), 4) AS p50,
  ROUND(quantile_cont({c}, 0.75), 4) AS p75, ROUND(CAST(max({c}) AS DOUBLE), 4) AS max FROM rated {g}"""
             for c in cols]
    return with_sql(S.daily_cte(SEGMENT if keys else None),
                    "rated AS (SELECT *, sby_need / NULLIF(n_sby, 0) * 100 AS activation_rate FROM daily)") \
        + "\n" + _union(parts)


def _describe(spark, sf_dir, keys):
    d = daily_ops(spark, sf_dir, SEGMENT if keys else None).withColumn("activation_rate", activation_rate())
    k = ["series"] if keys else []
    return round4(Q.describe_long(d, ["n_sick", "calls", "n_duty", "n_sby", "sby_need", "dafted", "activation_rate"],
                                  keys=k))


@register("q6_describe", _describe_sql(False))
def q_describe(spark: SparkSession, sf_dir: str):
    return _describe(spark, sf_dir, False)


@register("q6_describe_segment", _describe_sql(True))
def q_describe_segment(spark: SparkSession, sf_dir: str):
    return _describe(spark, sf_dir, True)


# --- G1: correlation ---------------------------------------------------------------------------------

def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(NUMERIC):
        parts.append(f"SELECT '{a}' AS x, '{a}' AS y, CASE WHEN stddev_pop({a}) > 0 THEN CAST(1 AS DOUBLE) END AS r "
                     f"FROM modeling")
        for b in NUMERIC[i + 1:]:
            r = (f"ROUND(covar_pop({a}, {b}) / NULLIF(stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
                 f"stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END), 0), 4)")
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {r} AS r FROM modeling")
            parts.append(f"SELECT '{b}' AS x, '{a}' AS y, {r} AS r FROM modeling")
    return with_sql(S.modeling_ctes()) + "\n" + _union(parts)


@register("g1_correlation", _corr_sql())
def q_correlation(spark: SparkSession, sf_dir: str):
    return round4(X.corr_long(modeling(spark, sf_dir), NUMERIC))


# --- G2-G6: pivots and means ---------------------------------------------------------------------------

@register("g2_pivot_month_weekday", with_sql(S.modeling_ctes()) + "\nSELECT month, " + ", ".join(
    f"ROUND(avg({m}) FILTER (WHERE day_of_week = {d}), 4) AS {m}_{d}" for d in range(7) for m in MEASURES)
    + " FROM modeling GROUP BY month")
def q_pivot_month_weekday(spark: SparkSession, sf_dir: str):
    return round4(X.pivot_mean(modeling(spark, sf_dir, columns=MEASURES), "month", "day_of_week", list(range(7)),
                               MEASURES))


SEASON_SQL = ("CASE WHEN month IN (12, 1, 2) THEN 'Wi' WHEN month IN (3, 4, 5) THEN 'Fr' "
              "WHEN month IN (6, 7, 8) THEN 'So' ELSE 'He' END")


@register("g3_season_year_mean", with_sql(S.modeling_ctes()) + f"""
SELECT {SEASON_SQL} AS season_label, year, """ + ", ".join(f"ROUND(avg({m}), 4) AS {m}" for m in MEASURES)
    + " FROM modeling GROUP BY 1, 2")
def q_season_year(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, columns=MEASURES).withColumn("season_label", cal.season_label("month"))
    return round4(X.mean_by(m, ["season_label", "year"], MEASURES))


@register("g4_season_unstack", with_sql(S.modeling_ctes()) + "\nSELECT year, " + ", ".join(
    f"ROUND(avg({m}) FILTER (WHERE {SEASON_SQL} = '{s}'), 4) AS {m}_{s}" for s in cal.SEASON_ORDER for m in MEASURES)
    + " FROM modeling GROUP BY year")
def q_season_unstack(spark: SparkSession, sf_dir: str):
    m = modeling(spark, sf_dir, columns=MEASURES).withColumn("season_label", cal.season_label("month"))
    return round4(X.pivot_mean(m, "year", "season_label", cal.SEASON_ORDER, MEASURES))


@register("g5_month_mean", with_sql(S.modeling_ctes()) + "\nSELECT month, " + ", ".join(
    f"ROUND(avg({m}), 4) AS {m}" for m in MEASURES) + " FROM modeling GROUP BY month")
def q_month_mean(spark: SparkSession, sf_dir: str):
    return round4(X.mean_by(modeling(spark, sf_dir, columns=MEASURES), ["month"], MEASURES))


@register("g6_weekday_mean", with_sql(S.modeling_ctes()) + "\nSELECT day_of_week, " + ", ".join(
    f"ROUND(avg({m}), 4) AS {m}" for m in MEASURES)
    + ", ['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'][day_of_week + 1] AS weekday_label FROM modeling GROUP BY day_of_week")
def q_weekday_mean(spark: SparkSession, sf_dir: str):
    return round4(X.weekday_means(modeling(spark, sf_dir, columns=MEASURES), MEASURES))


# --- W1-W4: decomposition ------------------------------------------------------------------------------

def _decompose_sql(keys: bool) -> str:
    k = "series, " if keys else ""
    pk = "series, " if keys else ""
    long = _union([f"SELECT {k}'{m}' AS measure, date, CAST({m} AS DOUBLE) AS observed FROM modeling"
                   for m in MEASURES])
    return with_sql(S.modeling_ctes(SEGMENT if keys else None), f"long AS ({long})", f"""s1 AS (
SELECT {k}measure, date, observed,
  row_number() OVER (PARTITION BY {pk}measure ORDER BY date) - 1 AS pos,
  count(*) OVER (PARTITION BY {pk}measure) AS n,
  (sum(observed) OVER (PARTITION BY {pk}measure ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)
   - CAST(0.5 AS DOUBLE) * lag(observed, 15) OVER (PARTITION BY {pk}measure ORDER BY date)
   - CAST(0.5 AS DOUBLE) * lead(observed, 15) OVER (PARTITION BY {pk}measure ORDER BY date)) / 30 AS c
FROM long)""", f"""s2 AS (SELECT *, CASE WHEN pos >= 15 AND pos < n - 15 THEN c END AS trend, pos % 30 AS phase FROM s1)""",
                    f"""s3 AS (SELECT *, avg(observed - trend) OVER (PARTITION BY {pk}measure, phase) AS pm FROM s2)""",
                    f"""ctr AS (SELECT {k}measure, avg(pm) AS centre FROM (SELECT DISTINCT {k}measure, phase, pm FROM s3) d
        GROUP BY {k}measure)""") + f"""
SELECT {', '.join('s3.' + c for c in (['series'] if keys else []))}{', ' if keys else ''}s3.measure, s3.date,
  ROUND(s3.observed, 4) AS observed, ROUND(s3.trend, 4) AS trend, ROUND(s3.pm - ctr.centre, 4) AS seasonal,
  ROUND(s3.observed - s3.trend - (s3.pm - ctr.centre), 4) AS resid
FROM s3 JOIN ctr ON ctr.measure = s3.measure{' AND ctr.series = s3.series' if keys else ''}"""


@register("w1_decompose", _decompose_sql(False))
def q_decompose(spark: SparkSession, sf_dir: str):
    return round4(X.decompose(modeling(spark, sf_dir, columns=MEASURES), MEASURES, 30))


@register("w4_decompose_segment", _decompose_sql(True))
def q_decompose_segment(spark: SparkSession, sf_dir: str):
    return round4(X.decompose(modeling(spark, sf_dir, segment=True, columns=MEASURES), MEASURES, 30, keys=["series"]))


# --- W5, W6, V3: positions, folds, splits -----------------------------------------------------------------

@register("w6_fold_ids", with_sql(S.daily_cte(SEGMENT)) + f"""
SELECT series, date, CAST(row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS BIGINT) AS position,
  CAST(ntile(5) OVER (PARTITION BY series ORDER BY date) - 1 AS INTEGER) AS fold
FROM daily WHERE date <= DATE '{TRAIN_END}'""")
def q_fold_ids(spark: SparkSession, sf_dir: str):
    d = (daily_ops(spark, sf_dir, SEGMENT, columns=[]).where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
         .select("series", "date"))
    d = cut_lineage(X.row_position(d, ["series"]))
    return V.fold_ids(d, 5, ["series"]).withColumn("position", F.col("position").cast("long"))


def _split_sql(exact: bool) -> str:
    h = "substr(md5(series || '|' || strftime(date, '%Y-%m-%d') || '|42'), 1, 8)"
    if exact:
        flag = (f"row_number() OVER (PARTITION BY series ORDER BY {h}, series, date) "
                f"<= ceil(count(*) OVER (PARTITION BY series) * CAST(0.2 AS DOUBLE))")
    else:
        flag = f"{h} < '33333333'"
    return with_sql(S.daily_cte(SEGMENT)) + f"\nSELECT series, date, sby_need, {flag} AS is_test FROM daily"


@register("v3_hash_split", _split_sql(False))
def q_hash_split(spark: SparkSession, sf_dir: str):
    d = daily_ops(spark, sf_dir, SEGMENT, columns=["sby_need"]).select("series", "date", "sby_need")
    return V.hash_split(d, ["series", "date"])


@register("v3_hash_split_exact", _split_sql(True))
def q_hash_split_exact(spark: SparkSession, sf_dir: str):
    d = daily_ops(spark, sf_dir, SEGMENT, columns=["sby_need"]).select("series", "date", "sby_need")
    return V.hash_split(d, ["series", "date"], keys=["series"], exact=True)


# --- V4: standardisation fitted on the training rows -----------------------------------------------------

@register("v4_standardise", with_sql(S.modeling_ctes(SEGMENT),
                                     "sp AS (SELECT *, substr(md5(series || '|' || strftime(date, '%Y-%m-%d') || '|42'), 1, 8) < '33333333' AS is_test FROM modeling)",
                                     "st AS (SELECT series, " + ", ".join(
                                         f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd" for c in FEATURES)
                                     + " FROM sp WHERE NOT is_test GROUP BY series)") + "\nSELECT sp.series, sp.date, sp.is_test, "
          + ", ".join(f"ROUND((sp.{c} - st.{c}_mu) / COALESCE(NULLIF(st.{c}_sd, 0), 1), 4) AS {c}_scaled" for c in FEATURES)
          + " FROM sp JOIN st ON st.series = sp.series")
def q_standardise(spark: SparkSession, sf_dir: str):
    m = V.hash_split(modeling(spark, sf_dir, segment=True), ["series", "date"])
    out = V.standardise(m, FEATURES, ~F.col("is_test"), ["series"], suffix="_scaled")
    return round4(out.select("series", "date", "is_test", *[f"{c}_scaled" for c in FEATURES]))


# --- V1, V6, V7: metrics on stand-in predictions ------------------------------------------------------------

def _standin_long(spark, sf_dir):
    m = V.hash_split(modeling(spark, sf_dir, segment=True, columns=["calls", "n_sick", "sby_need"]), ["series", "date"])
    test = m.where(F.col("is_test"))
    entries = [F.struct(F.lit("calls quarter (1 features)").alias("model"), standin("calls").alias("prediction")),
               F.struct(F.lit("sick half (1 features)").alias("model"),
                        (F.col("n_sick") * F.lit(0.5) + F.lit(1.0)).alias("prediction"))]
    return test.select("series", "date", F.col("sby_need").cast("double").alias("y"), F.inline(F.array(*entries)))


def _standin_sql() -> str:
    return with_sql(S.modeling_ctes(SEGMENT),
                    "sp AS (SELECT * FROM modeling WHERE substr(md5(series || '|' || strftime(date, '%Y-%m-%d') || '|42'), 1, 8) < '33333333')",
                    f"lng AS (SELECT series, date, CAST(sby_need AS DOUBLE) AS y, 'calls quarter (1 features)' AS model, "
                    f"{sql_standin('calls')} AS prediction FROM sp UNION ALL SELECT series, date, CAST(sby_need AS DOUBLE), "
                    f"'sick half (1 features)', n_sick * CAST(0.5 AS DOUBLE) + CAST(1 AS DOUBLE) FROM sp)",
                    """met AS (SELECT series, model, count(*) AS n, avg(abs(y - prediction)) AS mae,
  avg((y - prediction) * (y - prediction)) AS mse, var_pop(y) AS vy FROM lng GROUP BY series, model)""")


@register("v1_metrics", _standin_sql() + """
SELECT series, model, n, ROUND(mae, 4) AS mae, ROUND(mse, 4) AS mse, ROUND(sqrt(mse), 4) AS rmse,
  ROUND(CASE WHEN vy > 0 THEN 1 - mse / vy WHEN mse = 0 THEN 1 ELSE 0 END, 4) AS r2 FROM met""")
def q_metrics(spark: SparkSession, sf_dir: str):
    return round4(V.regression_metrics(_standin_long(spark, sf_dir), "y", "prediction", ["series", "model"]))


@register("v6_residuals", _standin_sql() + """
SELECT model, series, date, ROUND(y, 4) AS y, ROUND(prediction, 4) AS y_pred, ROUND(y - prediction, 4) AS residual
FROM lng""")
def q_residuals(spark: SparkSession, sf_dir: str):
    lng = _standin_long(spark, sf_dir)
    return round4(lng.select("model", "series", "date", "y", F.col("prediction").alias("y_pred"),
                             (F.col("y") - F.col("prediction")).alias("residual")))


@register("v7_mse_ranking", _standin_sql() + """
SELECT series, model, ROUND(mse, 4) AS mse, trim(split_part(model, '(', 1)) AS label FROM met""")
def q_mse_ranking(spark: SparkSession, sf_dir: str):
    met = V.regression_metrics(_standin_long(spark, sf_dir), "y", "prediction", ["series", "model"])
    return round4(V.mse_ranking(met).select("series", "model", "mse", "label"))


# --- R8, R10, R11: panel, pair histogram, densities ----------------------------------------------------------

@register("r8_measure_panel", with_sql(S.modeling_ctes(SEGMENT)) + "\n" + _union([
    f"SELECT series, date, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM modeling" for m in PANEL]))
def q_measure_panel(spark: SparkSession, sf_dir: str):
    return X.measure_panel(modeling(spark, sf_dir, segment=True), PANEL, ["series"])


def _pairs_sql() -> str:
    b = ", ".join(f"CAST(min({m}) AS DOUBLE) AS lo_{m}, CAST(max({m}) AS DOUBLE) AS hi_{m}" for m in PANEL)

    def binx(m):
        return (f"CAST(CASE WHEN hi_{m} = lo_{m} THEN 0 ELSE least(floor((CAST({m} AS DOUBLE) - lo_{m}) / "
                f"(hi_{m} - lo_{m}) * 20), 19) END AS INTEGER)")
    parts = []
    for i, a in enumerate(PANEL):
        for c in PANEL[i + 1:]:
            parts.append(f"SELECT '{a}' AS x, '{c}' AS y, {binx(a)} AS x_bin, {binx(c)} AS y_bin FROM modeling, bnd")
    return with_sql(S.modeling_ctes(), f"bnd AS (SELECT {b} FROM modeling)", f"pr AS ({_union(parts)})") + """
SELECT x, y, x_bin, y_bin, count(*) AS n FROM pr GROUP BY ALL"""


@register("r10_binned_pairs", _pairs_sql())
def q_binned_pairs(spark: SparkSession, sf_dir: str):
    # two passes (bin edges, then bins): read a materialised daily table, not the order lineage twice
    return X.binned_pairs(cut_lineage(modeling(spark, sf_dir)), PANEL, 20)


def _density_sql() -> str:
    vals = _union([f"SELECT '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM modeling" for m in PANEL])
    return with_sql(S.modeling_ctes(), f"v0 AS ({vals})",
                    "vals AS (SELECT measure, value, count(*) AS w FROM v0 WHERE value IS NOT NULL GROUP BY 1, 2)",
                    """st AS (SELECT measure, sum(w) AS n, min(value) AS lo, max(value) AS hi,
  sqrt(greatest(0, (sum(w * value * value) - sum(w * value) * sum(w * value) / sum(w)) / (sum(w) - 1))) AS sd
  FROM vals GROUP BY measure)""",
                    "st2 AS (SELECT *, sd * pow(n, -0.2) AS h FROM st WHERE sd > 0)",
                    """grid AS (SELECT measure, n, h, gi, lo - 3 * h + (hi - lo + 2 * 3 * h) * gi / 199 AS x
  FROM st2, range(200) r(gi))""") + """
SELECT g.measure, CAST(g.gi AS INTEGER) AS gi, ROUND(g.x, 4) AS x,
  ROUND(sum(v.w * exp(-0.5 * ((g.x - v.value) / g.h) * ((g.x - v.value) / g.h))) / (g.n * g.h * sqrt(2 * pi())), 4) AS density
FROM grid g JOIN vals v ON v.measure = g.measure GROUP BY g.measure, g.gi, g.x, g.n, g.h"""


@register("r11_density", _density_sql())
def q_density(spark: SparkSession, sf_dir: str):
    return round4(X.density(cut_lineage(modeling(spark, sf_dir)), PANEL, 200, 3.0))


# --- J5, O3: wide prediction table and arg-min per series ----------------------------------------------

def _model_id(name: str) -> str:
    return name.split(" (")[0].replace(" ", "_")


@register("j5_predictions_wide", _standin_sql() + """
SELECT series, date, ROUND(y, 4) AS y,
  ROUND(max(prediction) FILTER (WHERE model = 'calls quarter (1 features)'), 4) AS calls_quarter_pred,
  ROUND(max(prediction) FILTER (WHERE model = 'sick half (1 features)'), 4) AS sick_half_pred
FROM lng GROUP BY series, date, y""")
def q_predictions_wide(spark: SparkSession, sf_dir: str):
    lng = _standin_long(spark, sf_dir).withColumn("model", F.split("model", r" \(").getItem(0))
    lng = lng.withColumn("model", F.regexp_replace("model", " ", "_"))
    return round4(V.predictions_wide(lng, ["series", "date", "y"], ["calls_quarter", "sick_half"]))


@register("o3_best_candidate", _standin_sql() + """
SELECT series, model, ROUND(mse, 4) AS mse,
  CAST(row_number() OVER (PARTITION BY series ORDER BY mse, model) AS INTEGER) AS rank FROM met""")
def q_best_candidate(spark: SparkSession, sf_dir: str):
    met = V.regression_metrics(_standin_long(spark, sf_dir), "y", "prediction", ["series", "model"])
    return round4(V.best_per_group(met, ["series"], ["mse", "model"]).select("series", "model", "mse", "rank"))


# --- P7-P9: inclusive date filters ----------------------------------------------------------------------

@register("p9_date_filters", with_sql(S.daily_cte(SEGMENT)) + f"""
SELECT 'train' AS part, series, CAST(count(*) AS BIGINT) AS n_days, CAST(sum(calls) AS BIGINT) AS calls
  FROM daily WHERE date <= DATE '{TRAIN_END}' GROUP BY series
UNION ALL SELECT 'holdout', series, CAST(count(*) AS BIGINT), CAST(sum(calls) AS BIGINT) FROM daily
  WHERE date BETWEEN DATE '2001-06-01' AND DATE '2001-06-27' GROUP BY series
UNION ALL SELECT 'open_ended', series, CAST(count(*) AS BIGINT), CAST(sum(calls) AS BIGINT) FROM daily
  WHERE date >= DATE '2001-06-01' GROUP BY series""")
def q_date_filters(spark: SparkSession, sf_dir: str):
    d = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=["calls"]))  # three filtered branches read it
    parts = {"train": cal.between_dates(d, end=TRAIN_END),
             "holdout": cal.between_dates(d, "2001-06-01", "2001-06-27"),
             "open_ended": cal.between_dates(d, start="2001-06-01")}
    out = None
    for name, part in parts.items():
        agg = part.groupBy("series").agg(F.count(F.lit(1)).alias("n_days"), F.sum("calls").alias("calls"))
        agg = agg.select(F.lit(name).alias("part"), "series", "n_days", "calls")
        out = agg if out is None else out.unionByName(agg)
    return out
