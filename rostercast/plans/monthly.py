"""Entry points B and C: holdout evaluation and the monthly production roster.

``monthly_roster`` chains the reference's four production scripts into one
job graph: prepared history → dynamic cut-off (14th) → next-month calendar →
input forecasts → model input table → full training → scoring → policy →
daily and weekly tables.  Intermediate files become DataFrames; the only
driver-side values are the parameters.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.functions import calendar as cal
from rostercast.functions.roster import PROD_BUFFER, PROD_FLOOR, apply_policy
from rostercast.operators import forecast as FC
from rostercast.operators import learn as L
from rostercast.operators import roster as R
from rostercast.functions.scalars import attach_scalars, join_on_keys
from rostercast.operators import evaluate as V
from rostercast.session import cut_lineage, right_sized


@dataclass
class RosterConfig:
    n_duty: int | None = None             # None → each series' recent mean; the reference's own data: N_DUTY_DEFAULT
    floor: float | None = PROD_FLOOR      # None → computed from history (G8)
    buffer: float = PROD_BUFFER
    cutoff_day: int = 14
    cutoff_per_series: bool = False
    features: list[str] = field(default_factory=lambda: list(L.PROD_FEATURES))
    model_params: dict = field(default_factory=lambda: dict(L.PROD_PARAMS))
    calls_spec: FC.ForecastSpec = FC.CALLS_SPEC
    sick_spec: FC.ForecastSpec = FC.SICK_SPEC
    model_path: str | None = None


def future_frame(history: DataFrame, keys: list[str] | None = None, cutoff_day: int = 14,
                 per_series: bool = False) -> DataFrame:
    """The month after the cut-off for every series, with the history's calendar."""
    keys = keys or []
    cut = cal.training_cutoff(history, keys, cutoff_day, per_series=per_series)
    start, end = cal.next_month_window("cutoff")
    bounds = cut.select(*keys, start.alias("_s"), end.alias("_e"))
    spine = cal.date_spine(bounds, "_s", "_e", "date")
    return cal.with_calendar(spine, "date", extended=True)


def training_rows(history: DataFrame, keys: list[str] | None = None, cutoff_day: int = 14,
                  per_series: bool = False) -> DataFrame:
    """P10: rows up to the 14th of the month of the last day (``per_series``: each series' own last day)."""
    keys = (keys or []) if per_series else []
    cut = cal.training_cutoff(history, keys, cutoff_day, per_series=per_series).select(*keys, "cutoff")
    return attach_scalars(history, cut, keys).where(F.col("date") <= F.col("cutoff")).drop("cutoff")


def train_full(history: DataFrame, keys: list[str] | None = None, config: RosterConfig | None = None, estimator=None):
    """The production pipeline (scaler + learner, boosting by default) fitted on every row up to
    the dynamic cut-off, saved to ``config.model_path`` when given (S5)."""
    config = config or RosterConfig()
    learner = estimator if estimator is not None else L._gbt(**config.model_params)
    model = L.fit(training_rows(history, keys, config.cutoff_day, config.cutoff_per_series), config.features, learner)
    if config.model_path:
        L.save_model(model, config.model_path)
    return model


RECENT_DAYS = 28  # the last days of a series' training rows that stand for its duty strength


def recent_duty(train: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P12 from history: the rounded mean ``n_duty`` of each series' last ``RECENT_DAYS`` training days."""
    keys = keys or []
    last = train.groupBy(*keys).agg(F.max("date").alias("_last"))
    recent = attach_scalars(train, last, keys).where(F.col("date") > F.date_sub("_last", RECENT_DAYS))
    return recent.groupBy(*keys).agg(F.round(F.avg("n_duty")).cast("int").alias("n_duty"))


def forecast_inputs(train: DataFrame, future: DataFrame, keys: list[str], config: RosterConfig,
                    integer_inputs: bool = True, with_week: bool = False) -> DataFrame:
    """F1-F4 + F8: forecast calls and n_sick over ``future`` and build the model inputs."""
    def one(target, spec):
        hist = FC.regressor_frame(train, target, spec.regressors, keys)
        model = FC.fit_forecast(hist, spec, keys)
        fut = future.select(*keys, F.col("date").alias("ds"), *spec.regressors)
        return FC.predict_forecast(model, fut)

    # the two fits are independent Spark jobs: submit them side by side
    with ThreadPoolExecutor(max_workers=2) as pool:
        calls = pool.submit(one, "calls", config.calls_spec)
        sick = pool.submit(one, "n_sick", config.sick_spec)
        calls_fc, sick_fc = calls.result(), sick.result()
    n_duty = recent_duty(train, keys) if config.n_duty is None else config.n_duty
    return FC.combine_inputs(calls_fc, sick_fc, keys, n_duty, integer_inputs, with_week)


def monthly_roster(spark: SparkSession, history: DataFrame, keys: list[str] | None = None,
                   config: RosterConfig | None = None) -> dict[str, DataFrame]:
    """Entry point C on a prepared history (``with_calendar(extended=True)`` columns).

    Returns ``predictions`` (keys, date, calls, n_sick, year, n_duty,
    predicted_sby_need, predicted_sby_need_adjusted), ``daily`` and ``weekly``.
    The learner is one pooled pipeline over all given series.
    """
    keys = keys or []
    config = config or RosterConfig()
    # the prepared history feeds cut-off, calendar, two forecasts, training and the
    # floor: materialise it once in the shared checkpoint folder
    history = cut_lineage(history)
    train = training_rows(history, keys, config.cutoff_day, config.cutoff_per_series)
    future = future_frame(history, keys, config.cutoff_day, config.cutoff_per_series)
    inputs = forecast_inputs(train, future, keys, config, integer_inputs=True)
    model = L.fit(right_sized(train), config.features, L._gbt(**config.model_params))
    if config.model_path:
        L.save_model(model, config.model_path)
        model = L.load_model(config.model_path)
    scored = L.score(model, inputs, label=None).withColumnRenamed("prediction", "predicted_sby_need")
    if config.floor is None:
        scored = R.roster_with_policy(scored, "predicted_sby_need", R.floor_from_history(train, keys),
                                      config.buffer, keys, out_col="predicted_sby_need_adjusted").drop("min_driver")
    else:
        scored = scored.withColumn("predicted_sby_need_adjusted",
                                   apply_policy("predicted_sby_need", config.floor, config.buffer))
    preds = scored.select(*keys, "date", "calls", "n_sick", "year", "n_duty", "predicted_sby_need",
                          "predicted_sby_need_adjusted")
    return {"predictions": preds,
            "daily": R.daily_table(preds, "predicted_sby_need_adjusted", keys),
            "weekly": R.weekly_table(preds, "predicted_sby_need_adjusted", keys)}


def holdout_evaluation(spark: SparkSession, history: DataFrame, train_end: str, holdout: tuple[str, str],
                       keys: list[str] | None = None, config: RosterConfig | None = None,
                       partial: bool = True) -> dict[str, DataFrame]:
    """Entry point B: train ≤ ``train_end``; evaluate on the holdout window with
    true inputs and with forecast inputs; apply both policies; summarise.

    First a partial model, fitted on 80 % of the training rows, is evaluated on the
    other 20 % and on the holdout (``partial=False`` leaves it out), then the full
    one on the holdout.  Returns ``metrics`` (scenario rows), ``frame`` (per holdout
    day, full model) and ``summary`` (G13).  An empty holdout window raises.
    """
    keys = keys or []
    config = config or RosterConfig()
    history = cut_lineage(history)
    d0, d1 = F.lit(train_end).cast("date"), (F.lit(holdout[0]).cast("date"), F.lit(holdout[1]).cast("date"))
    train = right_sized(V.hash_split(history.where(F.col("date") <= d0), [*keys, "date"]))
    test = history.where(F.col("date").between(*d1))
    if test.isEmpty():
        raise ValueError(f"no rows in the holdout window {holdout[0]} to {holdout[1]}")
    fut = cal.with_calendar(test.select(*keys, "date"), "date", extended=True)
    est_inputs = cut_lineage(forecast_inputs(train, fut, keys, config, integer_inputs=False, with_week=True))

    def rows(df: DataFrame, pred: str, scenario: str) -> DataFrame:
        return df.select(*keys, "date", F.col("sby_need").cast("double").alias("y"), F.lit(scenario).alias("scenario"),
                         F.col(pred).alias("prediction"))

    def on_holdout(model) -> DataFrame:
        true_scored = L.score(model, test).withColumnRenamed("prediction", "pred_true")
        est_scored = (L.score(model, est_inputs, label=None)
                      .select(*keys, "date", F.col("prediction").alias("pred_est")))
        return join_on_keys(true_scored, est_scored, keys + ["date"])  # D8: join on date, not position

    def fitted(rows_: DataFrame):
        return L.fit(rows_, L.HOLDOUT_FEATURES, L._gbt(**config.model_params))

    scenarios = []
    with ThreadPoolExecutor(max_workers=2) as pool:  # the partial and the full fit are independent Spark jobs
        full = pool.submit(fitted, train)
        part = fitted(train.where(~F.col("is_test"))) if partial else None
        full = full.result()
    if partial:
        both = on_holdout(part)
        scenarios += [rows(L.score(part, train.where("is_test")), "prediction", "partial_test"),
                      rows(both, "pred_true", "partial_true_inputs"), rows(both, "pred_est", "partial_estimated_inputs")]
    frame = on_holdout(full)
    frame = attach_scalars(frame, R.floor_from_history(train, keys), keys)
    frame = frame.withColumns({
        "roster_true": apply_policy("pred_true", F.col("min_driver"), 1.0),
        "roster_adjusted": apply_policy("pred_est", F.col("min_driver"), config.buffer)})
    frame = R.with_roster_rate(frame, "roster_true", "rate_true")
    frame = R.with_roster_rate(frame, "roster_adjusted", "rate_adjusted")
    scenarios += [rows(frame, "pred_true", "true_inputs"), rows(frame, "pred_est", "estimated_inputs")]
    long = scenarios[0]
    for s in scenarios[1:]:
        long = long.unionByName(s)
    metrics = V.regression_metrics(long, "y", "prediction", keys + ["scenario"])
    summary = R.activation_summary(frame, [R.Scenario("actual", "activation_rate", None, False),
                                           R.Scenario("true_inputs", "rate_true", "roster_true", True),
                                           R.Scenario("adjusted", "rate_adjusted", "roster_adjusted", True)], keys)
    return {"metrics": metrics, "frame": frame, "summary": summary}
