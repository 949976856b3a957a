import datetime as dt

from pyspark.sql import functions as F

from fixtures import d
from rostercast.functions import calendar as cal


def _cal(spark, dates):
    df = spark.createDataFrame([(x,) for x in dates], "date date")
    return {r["date"]: r for r in cal.with_calendar(df, extended=True).collect()}


def test_iso_week_and_calendar_year(spark):
    rows = _cal(spark, [d("2018-12-31"), d("2019-01-01"), d("2020-12-31"), d("2021-01-01"), d("2021-01-04")])
    assert (rows[d("2018-12-31")]["week"], rows[d("2018-12-31")]["year"]) == (1, 2018)
    assert rows[d("2019-01-01")]["week"] == 1
    assert rows[d("2020-12-31")]["week"] == 53
    assert (rows[d("2021-01-01")]["week"], rows[d("2021-01-01")]["year"]) == (53, 2021)
    assert rows[d("2021-01-04")]["week"] == 1


def test_day_of_week_season_labels(spark):
    rows = _cal(spark, [d("2019-06-03"), d("2019-06-09"), d("2019-12-15"), d("2019-03-01"), d("2019-09-30")])
    assert rows[d("2019-06-03")]["day_of_week"] == 0 and rows[d("2019-06-03")]["weekday_label"] == "Mo"
    assert rows[d("2019-06-09")]["day_of_week"] == 6 and rows[d("2019-06-09")]["weekday_label"] == "So"
    assert rows[d("2019-12-15")]["season"] == 1 and rows[d("2019-12-15")]["season_label"] == "Wi"
    assert rows[d("2019-03-01")]["season"] == 2 and rows[d("2019-03-01")]["season_label"] == "Fr"
    assert rows[d("2019-09-30")]["season"] == 4 and rows[d("2019-09-30")]["season_label"] == "He"
    assert rows[d("2019-06-03")]["month_day_interaction"] == 5 * 7 + 0


def test_week_of_month(spark):
    # April 2019 starts on a Monday, September 2019 on a Sunday
    rows = _cal(spark, [d("2019-04-01"), d("2019-04-07"), d("2019-04-08"), d("2019-04-30"),
                        d("2019-09-01"), d("2019-09-02"), d("2019-09-30"), d("2019-03-31")])
    got = {k: v["week_of_month"] for k, v in rows.items()}
    assert got[d("2019-04-01")] == 1 and got[d("2019-04-07")] == 1 and got[d("2019-04-08")] == 2
    assert got[d("2019-04-30")] == 5
    assert got[d("2019-09-01")] == 1 and got[d("2019-09-02")] == 2 and got[d("2019-09-30")] == 6
    assert got[d("2019-03-31")] == 5  # March 2019 starts on a Friday


def test_holidays_2016_2019(spark):
    hol = cal.holidays_de(spark, 2016, 2019).collect()
    by_year = {}
    for r in hol:
        by_year.setdefault(r["date"].year, set()).add(r["date"])
    assert {y: len(v) for y, v in by_year.items()} == {2016: 9, 2017: 10, 2018: 9, 2019: 9}
    easter = {2016: "2016-03-27", 2017: "2017-04-16", 2018: "2018-04-01", 2019: "2019-04-21"}
    for y, e in easter.items():
        e = d(e)
        assert e - dt.timedelta(days=2) in by_year[y]          # Good Friday
        assert e + dt.timedelta(days=1) in by_year[y]          # Easter Monday
        assert e + dt.timedelta(days=39) in by_year[y]         # Ascension
        assert e + dt.timedelta(days=50) in by_year[y]         # Whit Monday
        assert e not in by_year[y]                             # Easter Sunday is not nationwide
    assert d("2017-10-31") in by_year[2017] and d("2018-10-31") not in by_year[2018]
    assert d("2019-10-03") in by_year[2019] and d("2019-12-26") in by_year[2019]


def test_holiday_flag_matches_dimension(spark):
    dates = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"),
                                                       F.lit("2021-12-31").cast("date"))).alias("date"))
    flagged = {r["date"] for r in cal.with_calendar(dates).where("holiday = 1").collect()}
    dim = {r["date"] for r in cal.holidays_de(spark, 1995, 2021).collect()}
    assert flagged == dim
    assert d("1994-11-16") in {r["date"] for r in cal.holidays_de(spark, 1994, 1994).collect()}


def test_cutoff_and_next_month(spark):
    df = spark.createDataFrame([("a", d("2019-05-27")), ("a", d("2019-05-01")), ("b", d("2019-06-10"))],
                               "k string, date date")
    cut = cal.training_cutoff(df, ["k"], per_series=True)
    start, end = cal.next_month_window("cutoff")
    rows = {r["k"]: r for r in cut.withColumns({"s": start, "e": end}).collect()}
    assert rows["a"]["cutoff"] == d("2019-05-14") and rows["a"]["s"] == d("2019-06-01")
    assert rows["a"]["e"] == d("2019-06-30")
    # last day before the 14th: the cut-off lies after the data and keeps all rows
    assert rows["b"]["cutoff"] == d("2019-06-14") and rows["b"]["e"] == d("2019-07-31")
    # by default all series are rostered for the same month
    assert {r["cutoff"] for r in cal.training_cutoff(df, ["k"]).collect()} == {d("2019-06-14")}
