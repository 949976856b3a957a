"""Entry points on the smallest driver tables, with small learners."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SMOKE_DIR
from rostercast.operators import learn as L
from rostercast.plans.monthly import RosterConfig, future_frame, holdout_evaluation, monthly_roster, training_rows
from rostercast.plans.prepare import prepare
from rostercast.plans.search import model_search
from rostercast.sources.driver_tables import daily_ops

SMALL = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}


def _history(spark, segment=True):
    raw = daily_ops(spark, SMOKE_DIR, "c_mktsegment" if segment else None)
    return prepare(raw, ["series"] if segment else [], extended=True)


def test_monthly_roster_per_segment(spark):
    hist = _history(spark)
    out = monthly_roster(spark, hist, ["series"], RosterConfig(floor=None, model_params=SMALL))
    preds = out["predictions"].collect()
    fut = future_frame(hist, ["series"]).groupBy("series").count().collect()
    assert len(preds) == sum(r["count"] for r in fut) and len(fut) == 5
    assert all(r["predicted_sby_need_adjusted"] >= 1 and 0 < r["n_duty"] < 100 for r in preds)
    assert all(r["predicted_sby_need_adjusted"] == int(r["predicted_sby_need_adjusted"]) for r in preds)
    daily_total = out["daily"].groupBy("series").agg(F.sum("drivers").alias("t")).collect()
    weekly_total = out["weekly"].groupBy("series").agg(F.sum("drivers").alias("t")).collect()
    assert sorted(map(tuple, daily_total)) == sorted(map(tuple, weekly_total))


def test_monthly_roster_production_floor(spark):
    out = monthly_roster(spark, _history(spark, segment=False), [], RosterConfig(model_params=SMALL))
    rows = out["predictions"].collect()
    assert rows and all(r["predicted_sby_need_adjusted"] >= 31 for r in rows)
    assert {r["date"].day for r in rows} == set(range(1, len(rows) + 1))  # the whole next month


def test_training_rows_dynamic_cutoff(spark):
    hist = _history(spark)
    cut = training_rows(hist, ["series"], per_series=True).groupBy("series").agg(F.max("date").alias("m")).collect()
    last = hist.groupBy("series").agg(F.max("date").alias("m")).collect()
    lim = {r["series"]: dt.date(r["m"].year, r["m"].month, 14) for r in last}
    assert all(r["m"] <= lim[r["series"]] for r in cut)


def test_holdout_evaluation(spark):
    hist = _history(spark, segment=False)
    out = holdout_evaluation(spark, hist, "2001-05-14", ("2001-06-01", "2001-06-27"),
                             config=RosterConfig(model_params=SMALL))
    scen = {r["scenario"] for r in out["metrics"].collect()}
    assert scen == {"partial_test", "partial_true_inputs", "partial_estimated_inputs", "true_inputs", "estimated_inputs"}
    summary = {r["scenario"]: r for r in out["summary"].collect()}
    assert set(summary) == {"actual", "true_inputs", "adjusted"}
    frame = out["frame"].collect()
    assert all(r["roster_true"] >= r["min_driver"] and r["roster_adjusted"] >= r["min_driver"] for r in frame)


def test_model_search_entry(spark):
    cfg = L.SearchConfig(models=["Gradient Boosting Regressor"], feature_counts=[1, 3], tune=False,
                         defaults={"Gradient Boosting Regressor": SMALL}, importance_trees=10)
    out = model_search(spark, _history(spark, segment=False), cfg, train_end="2001-05-14")
    res = {r["model"] for r in out["results"].collect()}
    assert "baseline" in res and any(m.startswith("Gradient Boosting Regressor (") for m in res)
    lc = out["learning_curves"].orderBy("train_size").collect()
    assert len(lc) == 5 and lc[-1]["train_size"] > lc[0]["train_size"]
    assert len(out["predictions"].columns) == 4  # date, y, baseline_pred, <best>_pred


def test_train_full_saves_pipeline(spark, tmp_path):
    from rostercast.operators.learn import load_model, score
    from rostercast.plans.monthly import train_full
    hist = _history(spark, segment=False)
    path = str(tmp_path / "prod-model")
    model = train_full(hist, [], RosterConfig(model_params=SMALL, model_path=path))
    again = load_model(path)
    a = [r["prediction"] for r in score(model, hist).orderBy("date").collect()]
    b = [r["prediction"] for r in score(again, hist).orderBy("date").collect()]
    assert a == b and len(model.stages) == 3  # assembler, scaler, learner travel together


def test_future_frame_june_2019_golden(spark):
    # golden: history up to late May 2019 → cut-off 2019-05-14 → forecast month 1…30 June 2019
    hist = spark.createDataFrame([(dt.date(2019, 5, 1) + dt.timedelta(days=i),) for i in range(27)], "date date")
    rows = future_frame(hist).orderBy("date").collect()
    assert [r["date"] for r in rows] == [dt.date(2019, 6, 1) + dt.timedelta(days=i) for i in range(30)]
    assert [r["date"] for r in rows if r["holiday"] == 1] == [dt.date(2019, 6, 10)]   # Whit Monday
    assert {r["year"] for r in rows} == {2019} and rows[0]["week_of_month"] == 1 and rows[-1]["week_of_month"] == 5
