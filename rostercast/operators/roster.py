"""Roster reports.

Inputs are daily tables (one row per series and day), so every operator here is
an aggregate or a projection over at most ``series × days`` rows.  Series keys
are optional everywhere; without keys the result is the reference's single
series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostercast.functions.calendar import iso_date_string, iso_week, kw_label
from rostercast.functions.roster import CURRENT_CAPACITY, apply_policy, roster_activation_rate
from rostercast.functions.scalars import attach_scalars


def floor_from_history(train: DataFrame, keys: list[str] | None = None, need_col: str = "sby_need",
                       out_col: str = "min_driver") -> DataFrame:
    """``ceil(mean(need))`` over the training rows, per series."""
    keys = keys or []
    return train.groupBy(*keys).agg(F.ceil(F.avg(need_col)).cast("double").alias(out_col))


def with_floor(df: DataFrame, train_cond: Column, keys: list[str] | None = None, need_col: str = "sby_need",
               out_col: str = "min_driver") -> DataFrame:
    """G8 in the same pass: ``ceil(mean(need))`` over each series' training rows
    (``train_cond``) attached to every row of the series.

    A window partitioned by the series keys (no ordering): one exchange of the
    daily rows, no second scan of the input and no join.
    """
    w = Window.partitionBy(*(keys or []))
    return df.withColumn(out_col, F.ceil(F.avg(F.when(train_cond, F.col(need_col))).over(w)).cast("double"))


def roster_with_policy(df: DataFrame, pred_col: str, floor: DataFrame | float, buffer: float = 1.0,
                       keys: list[str] | None = None, out_col: str = "roster",
                       floor_col: str = "min_driver") -> DataFrame:
    """Apply the floor/buffer policy; ``floor`` is a literal or a G8 table."""
    if isinstance(floor, DataFrame):
        df = attach_scalars(df, floor.select(*(keys or []), floor_col), keys)
        return df.withColumn(out_col, apply_policy(pred_col, F.col(floor_col), buffer))
    return df.withColumn(out_col, apply_policy(pred_col, floor, buffer))


@dataclass(frozen=True)
class Scenario:
    """One activation-rate scenario of the G13 summary.

    ``under_inclusive`` chooses the upper bound of the "under 100 %" set: the
    reference uses ``< 100`` for the actual rate and ``<= 100`` for the new
    rosters (D9).
    """

    name: str
    rate: str
    roster: str | None
    under_inclusive: bool


def activation_summary(df: DataFrame, scenarios: list[Scenario], keys: list[str] | None = None) -> DataFrame:
    """G9-G13 (+Q6 of each rate): one row per series and scenario.

    Scenarios are unpivoted with ``inline`` and summarised by a single
    ``groupBy`` (partial + final aggregation, one shuffle of pre-aggregated
    rows).  Quartiles are exact and linearly interpolated (``percentile``).
    """
    keys = keys or []
    entries = [F.struct(F.lit(s.name).alias("scenario"),
                        F.col(s.rate).cast("double").alias("rate"),
                        (F.col(s.roster).cast("double") if s.roster else F.lit(None).cast("double")).alias("roster"),
                        F.lit(s.under_inclusive).alias("under_inclusive"))
               for s in scenarios]
    long = df.select(*keys, F.inline(F.array(*entries)))
    rate = F.col("rate")
    over = rate > 100
    under = (rate > 0) & F.when(F.col("under_inclusive"), rate <= 100).otherwise(rate < 100)
    q = F.percentile(rate, [0.25, 0.5, 0.75])
    return (long.groupBy(*keys, "scenario")
            .agg(F.count(F.lit(1)).alias("n_days"),
                 F.count(rate).alias("rate_count"),
                 F.avg(rate).alias("rate_mean"),
                 F.stddev_samp(rate).alias("rate_std"),
                 F.min(rate).alias("rate_min"),
                 q.alias("_q"),
                 F.max(rate).alias("rate_max"),
                 (F.avg(F.when(over, F.lit(1.0)).otherwise(F.lit(0.0))) * F.lit(100.0)).alias("share_over_100"),
                 F.count_if(over).alias("days_over_100"),
                 F.avg(F.when(over, rate - F.lit(100.0))).alias("mean_excess_over_100"),
                 F.count_if(under).alias("days_under_100"),
                 F.avg(F.when(under, rate)).alias("mean_under_100"),
                 F.avg(F.when(rate == 0, F.col("roster"))).alias("mean_roster_rate_zero"),
                 F.count_if(rate.isNull()).alias("zero_capacity_days"))
            .withColumns({"rate_p25": F.element_at("_q", 1), "rate_p50": F.element_at("_q", 2),
                          "rate_p75": F.element_at("_q", 3)})
            .drop("_q"))


def daily_table(df: DataFrame, value_col: str = "predicted_sby_need_adjusted",
                keys: list[str] | None = None, date_col: str = "date") -> DataFrame:
    """``(keys…, day 'yyyy-MM-dd', drivers int)``."""
    keys = keys or []
    return df.select(*keys, iso_date_string(date_col).alias("day"),
                     F.col(value_col).cast("long").alias("drivers"))


def weekly_table(df: DataFrame, value_col: str = "predicted_sby_need_adjusted",
                 keys: list[str] | None = None, date_col: str = "date") -> DataFrame:
    """Weekly sums, weeks ending Sunday, labelled by that Sunday.

    Empty weeks inside each series' range are present with 0 (the resample
    semantics).  One pass: the daily rows are summed per week (partial
    aggregation), the weeks of each series are gathered into a map (bounded by
    the calendar: one entry per week) and the gap-free week spine is exploded
    from that same row — no self-join, so the input lineage is evaluated once.
    """
    keys = keys or []
    week_end = F.date_add(F.trunc(F.col(date_col), "week"), 6)
    sums = df.groupBy(*keys, week_end.alias("week_end")).agg(F.sum(value_col).alias("_total"))
    per_series = sums.groupBy(*keys).agg(F.min("week_end").alias("_lo"), F.max("week_end").alias("_hi"),
                                         F.map_from_entries(F.collect_list(F.struct("week_end", "_total")))
                                         .alias("_weeks"))
    out = per_series.select(*keys, "_weeks",
                            F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    return out.select(*keys, "week_end",
                      iso_week("week_end").alias("week"),
                      kw_label(iso_week("week_end")).alias("week_label"),
                      F.coalesce(F.try_element_at("_weeks", F.col("week_end")), F.lit(0)).cast("long")
                      .alias("drivers"))


def activation_compare(df: DataFrame, rates: dict[str, str], keys: list[str] | None = None,
                       date_col: str = "date") -> DataFrame:
    """Long ``(keys…, date, scenario, rate)`` for the by-day comparison chart."""
    keys = keys or []
    entries = [F.struct(F.lit(name).alias("scenario"), F.col(col).cast("double").alias("rate"))
               for name, col in rates.items()]
    return df.select(*keys, date_col, F.inline(F.array(*entries)))


def capacity_compare(df: DataFrame, roster_col: str, capacity: int | Column = CURRENT_CAPACITY,
                     keys: list[str] | None = None, date_col: str = "date") -> DataFrame:
    """Predicted roster beside the current fixed capacity, long form."""
    keys = keys or []
    cap = capacity if isinstance(capacity, Column) else F.lit(float(capacity))
    entries = [F.struct(F.lit("predicted").alias("kind"), F.col(roster_col).cast("double").alias("drivers")),
               F.struct(F.lit("current").alias("kind"), cap.cast("double").alias("drivers"))]
    return df.select(*keys, date_col, F.inline(F.array(*entries)))


def with_roster_rate(df: DataFrame, roster_col: str, out_col: str, need_col: str = "sby_need") -> DataFrame:
    """A2 as a column."""
    return df.withColumn(out_col, roster_activation_rate(need_col, roster_col))
