"""Registered queries: sources, preparation, calendar, roster policy and reports."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rostercast.functions import calendar as cal
from rostercast.functions.roster import PROD_BUFFER, apply_policy
from rostercast.functions.scalars import attach_scalars
from rostercast.operators import roster as R
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import (HOLDOUT, SEGMENT, TRAIN_END, modeling, register, round4, sql_standin,
                                      standin, with_sql)
from rostercast.session import cut_lineage
from rostercast.sources.driver_tables import daily_ops

MODEL_COLS = ("date, n_sick, calls, n_duty, sby_need, dafted, ROUND(activation_rate, 4) AS activation_rate, "
              "day_of_week, week, month, season, year, holiday")


# --- S1 / P1 / P4 / P6: the daily table -------------------------------------------------------

@register("s1_daily_ops", f"{S.daily_ops_sql(None)}")
def q_daily_ops(spark: SparkSession, sf_dir: str):
    return daily_ops(spark, sf_dir)


@register("s1_daily_ops_segment", f"{S.daily_ops_sql(SEGMENT)}")
def q_daily_ops_segment(spark: SparkSession, sf_dir: str):
    return daily_ops(spark, sf_dir, SEGMENT)


# --- A1 + C1-C5 + C9 + P1 + P4: the prepared modeling table ------------------------------------

@register("a1_prepare", with_sql(S.modeling_ctes()) + f"\nSELECT {MODEL_COLS} FROM modeling")
def q_prepare(spark: SparkSession, sf_dir: str):
    return round4(modeling(spark, sf_dir))


@register("a1_prepare_segment", with_sql(S.modeling_ctes(SEGMENT)) + f"\nSELECT series, {MODEL_COLS} FROM modeling")
def q_prepare_segment(spark: SparkSession, sf_dir: str):
    return round4(modeling(spark, sf_dir, segment=True))


# --- C6-C8, C11, C12, C17, C18: extended calendar ------------------------------------------------

@register("c7_calendar_extended", with_sql(S.daily_cte(), S.easter_ctes("daily")) + f"""
SELECT t.date, {S.calendar_cols('t.date')},
  CAST(day(t.date) AS INTEGER) AS day,
  {S.week_of_month_expr('t.date')} AS week_of_month,
  CAST((month(t.date) - 1) * 7 + isodow(t.date) - 1 AS INTEGER) AS month_day_interaction,
  CASE WHEN month(t.date) IN (12, 1, 2) THEN 'Wi' WHEN month(t.date) IN (3, 4, 5) THEN 'Fr'
       WHEN month(t.date) IN (6, 7, 8) THEN 'So' ELSE 'He' END AS season_label,
  ['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'][isodow(t.date)] AS weekday_label,
  'KW ' || CAST(weekofyear(t.date) AS VARCHAR) AS week_label,
  strftime(t.date, '%Y-%m-%d') AS day_string,
  {S.holiday_expr('t.date', 'e.easter')} AS holiday
FROM daily t JOIN easter e ON e.y = year(t.date)""")
def q_calendar_extended(spark: SparkSession, sf_dir: str):
    d = daily_ops(spark, sf_dir, columns=[]).select("date")
    d = cal.with_calendar(d, extended=True)
    return d.select("date", "day_of_week", "week", "month", "season", "year", "day", "week_of_month",
                    "month_day_interaction", "season_label", "weekday_label",
                    cal.kw_label("week").alias("week_label"), cal.iso_date_string("date").alias("day_string"),
                    "holiday")


# --- C10: the holiday dimension for the years of the history ----------------------------------------

@register("c10_holidays", with_sql(S.daily_cte(), S.easter_ctes("daily")) + """,
fixed AS (SELECT y, make_date(y, m, d) AS date FROM yrs, (VALUES (1, 1), (5, 1), (10, 3), (12, 25), (12, 26)) v(m, d)),
movable AS (SELECT e.y, CAST(e.easter + o AS DATE) AS date FROM easter e, (VALUES (-2), (1), (39), (50)) v(o)),
allh AS (SELECT * FROM fixed UNION ALL SELECT * FROM movable
         UNION ALL SELECT y, DATE '2017-10-31' FROM yrs WHERE y = 2017)
SELECT date, CAST(count(*) AS BIGINT) AS n_entries FROM allh WHERE y >= 1990 GROUP BY date""")
def q_holidays(spark: SparkSession, sf_dir: str):
    years = daily_ops(spark, sf_dir, columns=[]).select(F.year("date").alias("y")).distinct()
    return cal.holidays_for_years(years, "y").groupBy("date").agg(F.count(F.lit(1)).alias("n_entries"))


# --- P10, C13, C14, G7: cut-off per series and the next month ---------------------------------------

@register("p10_cutoff_next_month", with_sql(S.daily_cte(SEGMENT)) + """,
cut AS (SELECT DISTINCT series, max(date) OVER () AS max_date,
        CAST(date_trunc('month', max(date) OVER ()) AS DATE) + 13 AS cutoff FROM daily)
SELECT c.series, c.max_date, c.cutoff,
  CAST(date_trunc('month', c.cutoff + INTERVAL 1 MONTH) AS DATE) AS month_start,
  CAST(last_day(c.cutoff + INTERVAL 1 MONTH) AS DATE) AS month_end,
  CAST((SELECT count(*) FROM daily d WHERE d.series = c.series AND d.date <= c.cutoff) AS BIGINT) AS n_train
FROM cut c""")
def q_cutoff(spark: SparkSession, sf_dir: str):
    daily = cut_lineage(daily_ops(spark, sf_dir, SEGMENT, columns=[]))  # read by two branches
    cut = cal.training_cutoff(daily, ["series"])
    start, end = cal.next_month_window("cutoff")
    n_train = (attach_scalars(daily, cut.select("series", "cutoff"), ["series"])
               .where(F.col("date") <= F.col("cutoff")).groupBy("series").agg(F.count(F.lit(1)).alias("n_train")))
    return (cut.withColumns({"month_start": start, "month_end": end})
            .join(n_train, "series", "left")
            .select("series", "max_date", "cutoff", "month_start", "month_end",
                    F.coalesce("n_train", F.lit(0)).alias("n_train")))


# --- G8 + J4 + R1-R3 + A2: policy rosters over every day of every segment -----------------------------

def _policy_frame(spark: SparkSession, sf_dir: str):
    """Prepared segment table with a stand-in prediction, the G8 floor from the
    training rows, the true-input roster (R3: floor only) and the adjusted
    roster (R2: floor + 15 % buffer), and both A2 rates."""
    m = modeling(spark, sf_dir, segment=True, columns=["calls", "sby_need", "n_sby"]).withColumn("pred", standin("calls"))
    m = R.with_floor(m, F.col("date") <= F.lit(TRAIN_END).cast("date"), ["series"])
    df = m.withColumn("roster_true", apply_policy("pred", F.col("min_driver"), 1.0))
    df = df.withColumn("roster_adjusted", apply_policy("pred", F.col("min_driver"), PROD_BUFFER))
    df = R.with_roster_rate(df, "roster_true", "rate_true")
    return R.with_roster_rate(df, "roster_adjusted", "rate_adjusted")


def _policy_sql() -> str:
    return S.modeling_ctes(SEGMENT) + f""",
fl AS (SELECT series, CAST(ceil(avg(sby_need)) AS DOUBLE) AS min_driver FROM modeling
       WHERE date <= DATE '{TRAIN_END}' GROUP BY series),
pol AS (SELECT m.*, f.min_driver, {sql_standin('m.calls')} AS pred,
  CAST(ceil(CASE WHEN {sql_standin('m.calls')} < f.min_driver THEN f.min_driver
                 ELSE {sql_standin('m.calls')} * CAST(1.0 AS DOUBLE) END) AS DOUBLE) AS roster_true,
  CAST(ceil(CASE WHEN {sql_standin('m.calls')} < f.min_driver THEN f.min_driver
                 ELSE {sql_standin('m.calls')} * CAST(1.15 AS DOUBLE) END) AS DOUBLE) AS roster_adjusted
  FROM modeling m JOIN fl f ON f.series = m.series),
rates AS (SELECT *, CASE WHEN sby_need = 0 THEN 0.0 ELSE sby_need / NULLIF(roster_true, 0) * 100 END AS rate_true,
  CASE WHEN sby_need = 0 THEN 0.0 ELSE sby_need / NULLIF(roster_adjusted, 0) * 100 END AS rate_adjusted FROM pol)"""


@register("r2_policy_rosters", with_sql(_policy_sql()) + """
SELECT series, date, min_driver, ROUND(pred, 4) AS pred, roster_true, roster_adjusted,
  ROUND(rate_true, 4) AS rate_true, ROUND(rate_adjusted, 4) AS rate_adjusted FROM rates""")
def q_policy(spark: SparkSession, sf_dir: str):
    return round4(_policy_frame(spark, sf_dir).select("series", "date", "min_driver", "pred", "roster_true",
                                                     "roster_adjusted", "rate_true", "rate_adjusted"))


@register("r1_production_policy", with_sql(S.daily_cte()) + f"""
SELECT date, ROUND({sql_standin('calls')}, 4) AS predicted_sby_need,
  CAST(ceil(CASE WHEN {sql_standin('calls')} < CAST(31 AS DOUBLE) THEN CAST(31 AS DOUBLE)
                 ELSE {sql_standin('calls')} * CAST(1.15 AS DOUBLE) END) AS DOUBLE) AS predicted_sby_need_adjusted
FROM daily""")
def q_production_policy(spark: SparkSession, sf_dir: str):
    from rostercast.functions.roster import PROD_FLOOR, apply_policy
    d = daily_ops(spark, sf_dir, columns=["calls"]).withColumn("predicted_sby_need", standin("calls"))
    return round4(d.select("date", "predicted_sby_need",
                           apply_policy("predicted_sby_need", PROD_FLOOR, PROD_BUFFER)
                           .alias("predicted_sby_need_adjusted")))


# --- G9-G13: activation summary, three scenarios per segment ----------------------------------------

SUMMARY_COLS = ["n_days", "rate_count", "rate_mean", "rate_std", "rate_min", "rate_p25", "rate_p50", "rate_p75",
                "rate_max", "share_over_100", "days_over_100", "mean_excess_over_100", "days_under_100",
                "mean_under_100", "mean_roster_rate_zero", "zero_capacity_days"]


def _summary_sql(where: str) -> str:
    def block(name: str, rate: str, roster: str, incl: bool) -> str:
        under = f"{rate} > 0 AND {rate} {'<=' if incl else '<'} 100"
        return f"""SELECT series, '{name}' AS scenario, CAST(count(*) AS BIGINT) AS n_days,
  CAST(count({rate}) AS BIGINT) AS rate_count, ROUND(avg({rate}), 4) AS rate_mean,
  ROUND(stddev_samp({rate}), 4) AS rate_std, ROUND(min({rate}), 4) AS rate_min,
  ROUND(quantile_cont({rate}, 0.25), 4) AS rate_p25, ROUND(quantile_cont({rate}, 0.5), 4) AS rate_p50,
  ROUND(quantile_cont({rate}, 0.75), 4) AS rate_p75, ROUND(max({rate}), 4) AS rate_max,
  ROUND(avg(CASE WHEN {rate} > 100 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100, 4) AS share_over_100,
  CAST(count(*) FILTER (WHERE {rate} > 100) AS BIGINT) AS days_over_100,
  ROUND(avg(CASE WHEN {rate} > 100 THEN {rate} - 100 END), 4) AS mean_excess_over_100,
  CAST(count(*) FILTER (WHERE {under}) AS BIGINT) AS days_under_100,
  ROUND(avg(CASE WHEN {under} THEN {rate} END), 4) AS mean_under_100,
  ROUND(avg(CASE WHEN {rate} = 0 THEN CAST({roster} AS DOUBLE) END), 4) AS mean_roster_rate_zero,
  CAST(count(*) FILTER (WHERE {rate} IS NULL) AS BIGINT) AS zero_capacity_days
FROM rates {where} GROUP BY series"""
    return with_sql(_policy_sql()) + "\n" + "\nUNION ALL\n".join([
        block("actual", "activation_rate", "NULL", False),
        block("true_inputs", "rate_true", "roster_true", True),
        block("adjusted", "rate_adjusted", "roster_adjusted", True)])


# the reference reports the idle-roster mean (G12) only for the new rosters
SCENARIOS = [R.Scenario("actual", "activation_rate", None, False),
             R.Scenario("true_inputs", "rate_true", "roster_true", True),
             R.Scenario("adjusted", "rate_adjusted", "roster_adjusted", True)]


def _summary(df):
    return round4(R.activation_summary(df, SCENARIOS, ["series"]).select("series", "scenario", *SUMMARY_COLS))


@register("g13_activation_summary", _summary_sql(""))
def q_activation_summary(spark: SparkSession, sf_dir: str):
    return _summary(_policy_frame(spark, sf_dir))


@register("g13_activation_summary_holdout",
          _summary_sql(f"WHERE date BETWEEN DATE '{HOLDOUT[0]}' AND DATE '{HOLDOUT[1]}'"))
def q_activation_summary_holdout(spark: SparkSession, sf_dir: str):
    df = _policy_frame(spark, sf_dir).where(F.col("date").between(F.lit(HOLDOUT[0]).cast("date"),
                                                                  F.lit(HOLDOUT[1]).cast("date")))
    return _summary(df)


# --- G14, R4, R5, C18: daily and weekly roster tables -------------------------------------------------

@register("r5_weekly_roster", with_sql(_policy_sql()) + """,
wk AS (SELECT series, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, sum(roster_adjusted) AS total
       FROM rates GROUP BY 1, 2),
b AS (SELECT series, min(week_end) AS lo, max(week_end) AS hi FROM wk GROUP BY 1),
sp AS (SELECT series, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_end FROM b)
SELECT sp.series, sp.week_end, CAST(weekofyear(sp.week_end) AS INTEGER) AS week,
  'KW ' || CAST(weekofyear(sp.week_end) AS VARCHAR) AS week_label,
  CAST(COALESCE(wk.total, 0) AS BIGINT) AS drivers
FROM sp LEFT JOIN wk ON wk.series = sp.series AND wk.week_end = sp.week_end""")
def q_weekly_roster(spark: SparkSession, sf_dir: str):
    return R.weekly_table(_policy_frame(spark, sf_dir), "roster_adjusted", ["series"])


@register("r4_daily_roster", with_sql(_policy_sql()) + """
SELECT series, strftime(date, '%Y-%m-%d') AS day, CAST(roster_adjusted AS BIGINT) AS drivers FROM rates""")
def q_daily_roster(spark: SparkSession, sf_dir: str):
    return R.daily_table(_policy_frame(spark, sf_dir), "roster_adjusted", ["series"])


# --- R6, R7: comparison frames ---------------------------------------------------------------------

@register("r6_activation_compare", with_sql(_policy_sql()) + """
SELECT series, date, scenario, ROUND(rate, 4) AS rate FROM (
  SELECT series, date, 'actual' AS scenario, activation_rate AS rate FROM rates
  UNION ALL SELECT series, date, 'true_inputs', rate_true FROM rates
  UNION ALL SELECT series, date, 'adjusted', rate_adjusted FROM rates) u""")
def q_activation_compare(spark: SparkSession, sf_dir: str):
    return round4(R.activation_compare(_policy_frame(spark, sf_dir),
                                       {"actual": "activation_rate", "true_inputs": "rate_true",
                                        "adjusted": "rate_adjusted"}, ["series"]))


@register("r7_capacity_compare", with_sql(_policy_sql()) + """
SELECT series, date, kind, drivers FROM (
  SELECT series, date, 'predicted' AS kind, roster_adjusted AS drivers FROM rates
  UNION ALL SELECT series, date, 'current', CAST(90 AS DOUBLE) FROM rates) u""")
def q_capacity_compare(spark: SparkSession, sf_dir: str):
    return R.capacity_compare(_policy_frame(spark, sf_dir), "roster_adjusted", keys=["series"])


# --- S1, S3, S4, P1, P6: CSV round trip through the shared folder ----------------------------------------

@register("s3_csv_roundtrip", f"{S.daily_ops_sql(None)}")
def q_csv_roundtrip(spark: SparkSession, sf_dir: str):
    import os
    import uuid

    from rostercast.session import ensure_checkpoint_dir
    from rostercast.sources.files import read_daily, write_table

    path = os.path.join(ensure_checkpoint_dir(spark), f"daily-csv-{uuid.uuid4().hex}")
    raw = daily_ops(spark, sf_dir).withColumn("_idx", F.monotonically_increasing_id())
    write_table(raw.select("_idx", F.date_format("date", "yyyy-MM-dd").alias("date"), "n_sick", "calls", "n_duty",
                           "n_sby", "sby_need", "dafted"), path, fmt="csv")
    return read_daily(spark, path, fmt="csv")
