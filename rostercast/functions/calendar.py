"""Calendar expressions.

Everything here is a plain Column expression, so it stays inside whole-stage
codegen: no Python UDF, no join.  The holiday flag is computed per row from the
date itself (Easter by the Gregorian computus), which means the history, the
future spine and every series use the same rule without a dimension table.
``holidays_de`` still returns the dimension as a DataFrame (C10) for reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.functions.scalars import attach_scalars

# Nationwide German public holidays (no state given), as the
# reference's holiday calendar defines them.
#   fixed dates (month, day): New Year 1-1, Labour Day 5-1, German Unity Day 10-3,
#   Christmas Day 12-25, Second Christmas Day 12-26
#   Easter-relative offsets in days: Good Friday -2, Easter Monday +1,
#   Ascension Day +39, Whit Monday +50
#   one-off: Reformation Day 2017-10-31
#   Day of Repentance and Prayer (Wednesday before 23 November) up to 1994
#   no holidays before 1990
FIXED_HOLIDAYS = [("New Year's Day", 1, 1), ("Labour Day", 5, 1), ("German Unity Day", 10, 3),
                  ("Christmas Day", 12, 25), ("Second Day of Christmas", 12, 26)]
EASTER_HOLIDAYS = [("Good Friday", -2), ("Easter Monday", 1), ("Ascension Day", 39), ("Whit Monday", 50)]
REFORMATION_DAY_2017 = "2017-10-31"
FIRST_HOLIDAY_YEAR = 1990
LAST_REPENTANCE_YEAR = 1994

# German labels used by the reference's reports.
WEEKDAY_LABELS = ["Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"]  # Monday = 0
SEASON_LABELS = {"Wi": (12, 1, 2), "Fr": (3, 4, 5), "So": (6, 7, 8)}  # everything else "He"
SEASON_ORDER = ["Wi", "Fr", "So", "He"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _idiv(a: Column, b: int) -> Column:
    """Integer division for non-negative operands."""
    return F.floor(a / F.lit(b))


def day_of_week(d: Column | str) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_c(d)).cast("int")


def iso_week(d: Column | str) -> Column:
    """ISO-8601 week number (2018-12-31 is week 1 of 2019, year stays 2018)."""
    return F.weekofyear(_c(d)).cast("int")


def season_number(month: Column | str) -> Column:
    """C4: ``month % 12 // 3 + 1`` (1 winter … 4 autumn)."""
    return (_idiv(_c(month) % 12, 3) + 1).cast("int")


def week_of_month(d: Column | str) -> Column:
    """Monday-start week of the month, 1…6."""
    d = _c(d)
    first_dow = F.weekday(F.trunc(d, "month"))
    return (_idiv(F.dayofmonth(d) + first_dow - 1, 7) + 1).cast("int")


def easter_sunday(year: Column | str) -> Column:
    """Gregorian Easter Sunday of ``year`` (anonymous Gregorian algorithm)."""
    y = _c(year).cast("int")
    a = y % 19
    b = _idiv(y, 100)
    c = y % 100
    d = _idiv(b, 4)
    e = b % 4
    f = _idiv(b + 8, 25)
    g = _idiv(b - f + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    i = _idiv(c, 4)
    k = c % 4
    l_ = (32 + 2 * e + 2 * i - h - k) % 7
    m = _idiv(a + 11 * h + 22 * l_, 451)
    n = h + l_ - 7 * m + 114
    return F.make_date(y, _idiv(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def repentance_day(year: Column | str) -> Column:
    """Wednesday strictly before 23 November of ``year``."""
    nov23 = F.make_date(_c(year).cast("int"), F.lit(11), F.lit(23))
    # weekday: Monday 0 … Wednesday 2; days back to the previous Wednesday (1..7)
    back = ((F.weekday(nov23) - 2 + 7) % 7)
    back = F.when(back == 0, F.lit(7)).otherwise(back)
    return F.date_sub(nov23, back.cast("int"))


def is_holiday_de(d: Column | str) -> Column:
    """1 if the date is a nationwide German public holiday, else 0."""
    d = _c(d)
    y, m, dom = F.year(d), F.month(d), F.dayofmonth(d)
    fixed = F.lit(False)
    for _, mm, dd in FIXED_HOLIDAYS:
        fixed = fixed | ((m == mm) & (dom == dd))
    offset = F.datediff(d, easter_sunday(y))
    movable = offset.isin([off for _, off in EASTER_HOLIDAYS])
    one_off = d == F.lit(REFORMATION_DAY_2017).cast("date")
    repentance = (y <= LAST_REPENTANCE_YEAR) & (d == repentance_day(y))
    flag = (y >= FIRST_HOLIDAY_YEAR) & (fixed | movable | one_off | repentance)
    return F.when(flag, 1).otherwise(0).cast("int")


def season_label(month: Column | str) -> Column:
    """C11: Wi / Fr / So / He; December belongs to the winter of its own year."""
    m = _c(month)
    out = None
    for label, months in SEASON_LABELS.items():
        out = F.when(m.isin(list(months)), F.lit(label)) if out is None else out.when(m.isin(list(months)), F.lit(label))
    return out.otherwise(F.lit("He"))


def weekday_label(dow: Column | str) -> Column:
    """0 → Mo … 6 → So."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_LABELS]), _c(dow) + 1)


def kw_label(week: Column | str) -> Column:
    """``KW <n>``."""
    return F.concat(F.lit("KW "), _c(week).cast("string"))


def iso_date_string(d: Column | str) -> Column:
    """C17: ``yyyy-MM-dd``."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def month_day_interaction(month: Column | str, dow: Column | str) -> Column:
    """``(month - 1) * 7 + day_of_week``."""
    return ((_c(month) - 1) * 7 + _c(dow)).cast("int")


def with_calendar(df: DataFrame, date_col: str = "date", extended: bool = False) -> DataFrame:
    """C1-C7, C9 (and with ``extended`` C6, C8, C11, C12) as new columns.

    One projection: no shuffle, no join; Catalyst fuses it into the scan stage.
    """
    d = F.col(date_col)
    cols = {
        "day_of_week": day_of_week(d),
        "week": iso_week(d),
        "month": F.month(d).cast("int"),
        "season": season_number(F.month(d)),
        "year": F.year(d).cast("int"),
        "holiday": is_holiday_de(d),
    }
    if extended:
        cols.update({
            "day": F.dayofmonth(d).cast("int"),
            "week_of_month": week_of_month(d),
            "month_day_interaction": month_day_interaction(F.month(d), day_of_week(d)),
            "season_label": season_label(F.month(d)),
            "weekday_label": weekday_label(day_of_week(d)),
        })
    return df.withColumns(cols)


def holidays_de(spark: SparkSession, first_year: int | Column, last_year: int | Column) -> DataFrame:
    """The holiday dimension ``(date, name)`` for a closed year range."""
    years = spark.range(1).select(F.explode(F.sequence(F.lit(first_year) if isinstance(first_year, int) else first_year,
                                                       F.lit(last_year) if isinstance(last_year, int) else last_year)).alias("y"))
    return holidays_for_years(years, "y")


def holidays_for_years(years: DataFrame, year_col: str = "y") -> DataFrame:
    """C10 over a DataFrame of distinct years (e.g. derived from the history)."""
    y = F.col(year_col).cast("int")
    entries = [F.struct(F.lit(n).alias("name"), F.make_date(y, F.lit(mm), F.lit(dd)).alias("date"))
               for n, mm, dd in FIXED_HOLIDAYS]
    entries += [F.struct(F.lit(n).alias("name"), F.date_add(easter_sunday(y), off).alias("date"))
                for n, off in EASTER_HOLIDAYS]
    entries.append(F.struct(F.lit("Reformation Day").alias("name"),
                            F.when(y == 2017, F.lit(REFORMATION_DAY_2017).cast("date")).alias("date")))
    entries.append(F.struct(F.lit("Day of Repentance and Prayer").alias("name"),
                            F.when(y <= LAST_REPENTANCE_YEAR, repentance_day(y)).alias("date")))
    out = (years.where(y >= FIRST_HOLIDAY_YEAR)
           .select(F.inline(F.array(*entries)))
           .where(F.col("date").isNotNull()))
    return out.select("date", "name")


def training_cutoff(df: DataFrame, keys: list[str] | None = None, day: int = 14,
                    date_col: str = "date", per_series: bool = False) -> DataFrame:
    """The ``day``-th of the month of the last date.

    The last date is that of the whole table, so that all series are rostered for
    the same month; ``per_series=True`` takes each series' own.  Returns
    ``(keys…, max_date, cutoff)``; one row per series.
    """
    keys = keys or []
    agg = df.groupBy(*keys).agg(F.max(date_col).alias("max_date"))
    if keys and not per_series:
        agg = attach_scalars(agg.drop("max_date"), agg.agg(F.max("max_date").alias("max_date")))
    return agg.withColumn("cutoff", F.date_add(F.trunc("max_date", "month"), day - 1))


def next_month_window(cutoff: Column | str) -> tuple[Column, Column]:
    """C14: first and last day of the month after ``cutoff``."""
    start = F.trunc(F.add_months(_c(cutoff), 1), "month")
    return start, F.last_day(start)


def date_spine(bounds: DataFrame, start_col: str, end_col: str, out_col: str = "date") -> DataFrame:
    """One row per day between two inclusive bounds, for every row of ``bounds``."""
    other = [c for c in bounds.columns if c not in (start_col, end_col)]
    return bounds.select(*other, F.explode(F.sequence(F.col(start_col), F.col(end_col),
                                                      F.expr("INTERVAL 1 DAY"))).alias(out_col))


def between_dates(df: DataFrame, start: str | None = None, end: str | None = None,
                  date_col: str = "date") -> DataFrame:
    """Inclusive date filters (``<= end``, ``[start, end]``, ``>= start``).

    Plain comparisons on the date column, so Parquet scans receive them as
    pushed filters (and partition pruning applies when partitioned by date).
    """
    d = F.col(date_col)
    if start is not None:
        df = df.where(d >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(d <= F.lit(end).cast("date"))
    return df
