
from fixtures import JUNE_ROSTER, JUNE_WEEKLY, d, days
from rostercast.functions.roster import PROD_BUFFER, PROD_FLOOR, activation_rate, apply_policy
from rostercast.operators import roster as R


def test_production_policy_golden(spark):
    df = spark.createDataFrame([(d(a), p, adj) for a, p, adj in JUNE_ROSTER], "date date, p double, adj double")
    got = df.withColumn("mine", apply_policy("p", PROD_FLOOR, PROD_BUFFER)).collect()
    assert all(r["mine"] == r["adj"] for r in got)
    # the buffer is not applied to floored rows
    edge = spark.createDataFrame([(30.9,), (31.0,)], "p double").select(apply_policy("p", 31, 1.15).alias("x"))
    assert [r["x"] for r in edge.collect()] == [31.0, 36.0]


def test_weekly_totals_golden(spark):
    df = spark.createDataFrame([(d(a), adj) for a, _, adj in JUNE_ROSTER], "date date, adj double")
    got = [(r["week_end"].isoformat(), r["week"], r["drivers"]) for r in
           R.weekly_table(df, "adj").orderBy("week_end").collect()]
    assert got == JUNE_WEEKLY
    assert R.weekly_table(df, "adj").where("week_label = 'KW 22'").count() == 1


def test_weekly_gap_week_is_zero(spark):
    ds = [x for x in days("2019-06-03", 21) if not (d("2019-06-10") <= x <= d("2019-06-16"))]
    df = spark.createDataFrame([(x, 1.0) for x in ds], "date date, v double")
    got = {r["week_end"].isoformat(): r["drivers"] for r in R.weekly_table(df, "v").collect()}
    assert got == {"2019-06-09": 7, "2019-06-16": 0, "2019-06-23": 7}


def test_activation_rate_edges(spark):
    rows = [(0, 0), (0, 5), (5, 0), (5, 5), (4, 5), (6, 5), (1, 4), (3, 4)]  # (need, capacity)
    df = spark.createDataFrame(rows, "sby_need long, n_sby long").withColumn("rate", activation_rate())
    rates = [r["rate"] for r in df.collect()]
    assert rates[0] is None and rates[2] is None           # zero capacity → NULL (D11)
    assert rates[1] == 0.0 and rates[3] == 100.0 and rates[5] == 120.0


def test_activation_summary_semantics(spark):
    df = spark.createDataFrame([(d("2019-05-01"), 0, 10.0, 0.0), (d("2019-05-02"), 5, 5.0, 100.0),
                                (d("2019-05-03"), 6, 5.0, 120.0), (d("2019-05-04"), 2, 4.0, 50.0),
                                (d("2019-05-05"), 3, 0.0, None)],
                               "date date, sby_need long, roster double, rate double")
    s = {r["scenario"]: r for r in R.activation_summary(df, [R.Scenario("new", "rate", "roster", True),
                                                             R.Scenario("act", "rate", None, False)]).collect()}
    new, act = s["new"], s["act"]
    assert new["n_days"] == 5 and new["rate_count"] == 4 and new["zero_capacity_days"] == 1
    assert new["days_over_100"] == 1 and abs(new["share_over_100"] - 20.0) < 1e-12  # NULL counts in the denominator
    assert new["mean_excess_over_100"] == 20.0
    assert new["days_under_100"] == 2 and new["mean_under_100"] == 75.0           # <= 100 includes exactly 100
    assert act["days_under_100"] == 1 and act["mean_under_100"] == 50.0           # < 100 for the actual rate
    assert new["mean_roster_rate_zero"] == 10.0 and act["mean_roster_rate_zero"] is None


def test_empty_over_100_set_is_null(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 20.0)], "sby_need long, rate double")
    r = R.activation_summary(df, [R.Scenario("x", "rate", None, True)]).first()
    assert r["days_over_100"] == 0 and r["mean_excess_over_100"] is None and r["share_over_100"] == 0.0


def test_floor_from_history_per_series(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 10)], "series string, sby_need long")
    got = {r["series"]: r["min_driver"] for r in R.floor_from_history(df, ["series"]).collect()}
    assert got == {"a": 2.0, "b": 10.0}
    pol = R.roster_with_policy(spark.createDataFrame([("a", 1.2), ("b", 12.0)], "series string, p double"),
                               "p", R.floor_from_history(df, ["series"]), 1.15, ["series"])
    assert {r["series"]: r["roster"] for r in pol.collect()} == {"a": 2.0, "b": 14.0}
