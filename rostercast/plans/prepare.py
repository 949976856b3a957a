"""Entry point A.1: raw daily table → prepared modeling table.

One projection over the daily table: rate (A1), drop capacity (P1), calendar
(C1-C5, C9), integer casts (P4).  With series keys the same code prepares every
series at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostercast.functions.calendar import with_calendar
from rostercast.functions.roster import activation_rate

MODELING_COLUMNS = ["date", "n_sick", "calls", "n_duty", "sby_need", "dafted", "activation_rate",
                    "day_of_week", "week", "month", "season", "year", "holiday"]
INT_COLUMNS = ["day_of_week", "week", "month", "season", "year", "holiday"]
LONG_COLUMNS = ["n_sick", "calls", "n_duty", "sby_need", "dafted"]


def prepare(raw: DataFrame, keys: list[str] | None = None, extended: bool = False) -> DataFrame:
    """``raw(keys…, date, n_sick, calls, n_duty, n_sby, sby_need, dafted)`` → modeling table.

    Measures missing from ``raw`` (a daily table built with a measure subset)
    are simply absent from the result; the rate needs ``sby_need`` and ``n_sby``.
    """
    keys = keys or []
    df = raw
    if "sby_need" in df.columns and "n_sby" in df.columns:
        df = df.withColumn("activation_rate", activation_rate("sby_need", "n_sby"))
    if "n_sby" in df.columns:
        df = df.drop("n_sby")
    df = with_calendar(df, "date", extended=extended)
    df = df.withColumns({c: F.col(c).cast("long") for c in LONG_COLUMNS if c in df.columns})
    extra = [c for c in ("day", "week_of_month", "month_day_interaction", "season_label", "weekday_label")
             if extended]
    return df.select(*keys, *[c for c in MODELING_COLUMNS if c in df.columns], *extra)
