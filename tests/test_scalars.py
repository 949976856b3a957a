"""No row is lost when scalars are attached; folders and layouts of the session helpers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rostercast.functions import calendar as cal
from rostercast.functions.scalars import attach_scalars, join_on_keys
from rostercast.operators import explore as X
from rostercast.operators import forecast as FC
from rostercast.operators import roster as R
from rostercast.plans.monthly import future_frame, recent_duty, training_rows
from rostercast.session import right_sized, shared_dir

DAY = dt.date(2020, 3, 1)


def test_rows_without_a_scalar_stay(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "series string, x int")
    sc = spark.createDataFrame([("a", 10), (None, 30)], "series string, s int")
    got = {(r.series, r.x): r.s for r in attach_scalars(df, sc, ["series"]).collect()}
    assert got == {("a", 1): 10, ("b", 2): None, (None, 3): 30}
    assert join_on_keys(df, sc, ["series"], "inner").count() == 2


def test_one_row_without_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    one = spark.createDataFrame([(5,)], "s int")
    assert [r.s for r in attach_scalars(df, one).collect()] == [5, 5]
    assert [r.s for r in attach_scalars(df, one.limit(0)).collect()] == [None, None]
    with pytest.raises(Exception, match="more than one scalar row"):
        attach_scalars(df, one.union(one)).collect()


def test_training_rows_keep_null_series_and_one_month(spark):
    rows = [("a", dt.date(2020, 7, 31)), (None, dt.date(2020, 8, 1)), (None, dt.date(2020, 7, 3)), ("b", dt.date(2020, 8, 20))]
    df = spark.createDataFrame(rows, "series string, date date")
    assert training_rows(df, ["series"]).count() == 3
    months = {(r.series, r.date.month) for r in future_frame(df, ["series"]).collect()}
    assert months == {("a", 9), ("b", 9), (None, 9)}
    own = {(r.series, r.date.month) for r in future_frame(df, ["series"], per_series=True).collect()}
    assert own == {("a", 8), ("b", 9), (None, 9)}
    cut = {r.series: r.cutoff for r in cal.training_cutoff(df, ["series"], per_series=True).collect()}
    assert cut["a"] == dt.date(2020, 7, 14) and cut[None] == dt.date(2020, 8, 14)


def test_series_without_a_model_is_predicted_as_null(spark):
    hist = spark.createDataFrame([("a", DAY + dt.timedelta(days=i), float(i)) for i in range(40)], "series string, ds date, y double")
    spec = FC.ForecastSpec(n_changepoints=0, seasonalities=())
    model = FC.fit_forecast(hist, spec, ["series"])
    future = spark.createDataFrame([("a", DAY), ("new", DAY), (None, DAY)], "series string, ds date")
    got = {r.series: r.yhat for r in FC.predict_forecast(model, future).collect()}
    assert abs(got["a"]) < 1 and got["new"] is None and got[None] is None and len(got) == 3


def test_policy_without_a_floor_keeps_the_row(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "series string, p double")
    floor = spark.createDataFrame([("a", 31.0)], "series string, min_driver double")
    got = {r.series: r.min_driver for r in R.roster_with_policy(df, "p", floor, 1.15, ["series"]).collect()}
    assert got == {"a": 31.0, "b": None}


def test_recent_duty(spark):
    rows = [("a", DAY + dt.timedelta(days=i), 100 if i < 32 else 7) for i in range(60)] + [("b", DAY, 3)]
    got = {r.series: r.n_duty for r in recent_duty(spark.createDataFrame(rows, "series string, date date, n_duty long"), ["series"]).collect()}
    assert got == {"a": 7, "b": 3}


@pytest.mark.parametrize("n", [31, 45, 59, 60, 90])
def test_decomposition_of_short_series(spark, n):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=i), float(i % 30)) for i in range(n)], "date date, x double")
    rows = X.decompose(df, ["x"], 30).orderBy("date").collect()
    assert len(rows) == n
    if n < 60:
        assert all(r.seasonal is None and r.resid is None for r in rows)
    else:
        season = [r.seasonal for r in rows if r.seasonal is not None]
        assert len(season) == n and abs(sum(season[:30])) < 1e-6 and abs(season[1] - season[0] - 1) < 1e-6


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs:///shared/"}
    assert shared_dir(Session()) == "hdfs:///shared"


def test_right_sized_keeps_rows(spark):
    df = spark.range(1000).repartition(16, F.col("id"))
    small = right_sized(df)
    assert small.rdd.getNumPartitions() == 1 and small.count() == 1000
    assert right_sized(df, 300).rdd.getNumPartitions() == 4
