"""Registered queries: the boosted learners, their full grid, folds of whole days.

A boosted tree has no SQL in general; trees of one split do, and so has the ordered residual of an
oblivious tree, which the SQL takes from prefix sums in the permutation's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.operators import boost as B
from rostercast.operators import evaluate as V
from rostercast.operators import learn as L
from rostercast.plans import sql_parts as S
from rostercast.plans.catalog import SEGMENT, TRAIN_END, modeling, register, round4, with_sql
from rostercast.session import cut_lineage
from rostercast.sources.driver_tables import daily_ops

SPLIT_FEATURES = ["month", "day_of_week", "holiday"]  # few values, so every value is a cut point
HASH = "substr(md5(strftime(date, '%Y-%m-%d') || '|42'), 1, 8)"


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = modeling(spark, sf_dir, extended=True).where(f"date <= DATE '{TRAIN_END}'")
    m = cut_lineage(V.hash_split(m, ["date"]))
    return m.where("not is_test"), m.where("is_test")


# --- L3, L4, L6: one split -------------------------------------------------------------------------------------

ROWS_SQL = f"sp AS (SELECT *, {HASH} AS hsh, {HASH} < '33333333' AS is_test FROM modeling WHERE date <= DATE '{TRAIN_END}')"
LONG_SQL = " UNION ALL ".join(f"SELECT date, {i} AS f, CAST({c} AS DOUBLE) AS v, is_test FROM sp" for i, c in enumerate(SPLIT_FEATURES))


def _best_split(residuals: str, out: str, l2: float, least: float) -> str:
    """The split with the largest gain over ``residuals`` (date, g): feature, threshold; ties to the first."""
    side = "CASE WHEN {1} > 0 THEN {0} * {0} / ({1} + " + repr(l2) + ") ELSE 0 END"
    gain = f"0.5 * ({side.format('gl', 'hl')} + {side.format('(g - gl)', '(h - hl)')} - {side.format('g', 'h')})"
    return f"""{out}v AS (SELECT f, v, sum(g) AS g, CAST(count(*) AS DOUBLE) AS h FROM lng JOIN {residuals} USING (date) GROUP BY f, v),
{out}c AS (SELECT f, v, sum(g) OVER (PARTITION BY f ORDER BY v) AS gl, sum(h) OVER (PARTITION BY f ORDER BY v) AS hl,
  sum(g) OVER (PARTITION BY f) AS g, sum(h) OVER (PARTITION BY f) AS h FROM {out}v),
{out} AS (SELECT f, v FROM {out}c WHERE hl < h AND {gain} > {least} ORDER BY ROUND({gain}, 6) DESC, f, v LIMIT 1)"""


def _one_split_sql(l2: float, rate: float) -> str:
    return with_sql(S.modeling_ctes(), ROWS_SQL, f"lng AS ({LONG_SQL})",
                    "base AS (SELECT avg(CAST(sby_need AS DOUBLE)) AS b FROM sp WHERE NOT is_test)",
                    "r0 AS (SELECT date, sby_need - b AS g FROM sp, base WHERE NOT is_test)", _best_split("r0", "s", l2, 1e-12),
                    f"""lf AS (SELECT lng.v <= s.v AS goes, {rate} * sum(g) / (count(*) + {l2}) AS w FROM lng JOIN s ON s.f = lng.f JOIN r0 USING (date)
  WHERE NOT is_test GROUP BY 1)""") + """
SELECT lng.date, ROUND(b + w, 4) AS prediction FROM lng JOIN s ON s.f = lng.f JOIN lf ON lf.goes = (lng.v <= s.v), base WHERE is_test"""


def _scored(spark: SparkSession, sf_dir: str, spec: B.Boosting) -> DataFrame:
    train, test = _split(spark, sf_dir)
    model = B.fit_boosting(train, SPLIT_FEATURES, spec)
    return round4(B.score_boosting(model, test, SPLIT_FEATURES).select("date", "prediction"))


@register("l3_one_split", _one_split_sql(0.0, 0.1))
def q_one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosting, one round of one split: test predictions."""
    return _scored(spark, sf_dir, B.Boosting("level", 1, 0.1, depth=1))


@register("l4_newton_split", _one_split_sql(1.0, 0.3))
def q_newton_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regularised Newton boosting (λ = 1, rate 0.3), one round of one split: test predictions."""
    return _scored(spark, sf_dir, B.Boosting("level", 1, 0.3, depth=1, l2=1.0))


@register("l5_leafwise_split", _one_split_sql(0.0, 0.1))
def q_leafwise_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf-wise growth with two leaves: test predictions."""
    return _scored(spark, sf_dir, B.Boosting("leaf", 1, 0.1, leaves=2))


@register("l6_oblivious_ordered", with_sql(
    S.modeling_ctes(), ROWS_SQL, f"lng AS ({LONG_SQL})", "base AS (SELECT avg(CAST(sby_need AS DOUBLE)) AS b FROM sp WHERE NOT is_test)",
    "r0 AS (SELECT date, hsh, sby_need, sby_need - b AS g FROM sp, base WHERE NOT is_test)", _best_split("r0", "s", 3.0, 1e-12),
    "a1 AS (SELECT r0.*, lng.v <= s.v AS goes FROM r0 JOIN lng USING (date) JOIN s ON s.f = lng.f)",
    "w1 AS (SELECT goes, 0.5 * sum(g) / (count(*) + 3.0) AS w FROM a1 GROUP BY goes)",
    """r1 AS (SELECT date, g - coalesce(0.5 * sum(g) OVER before / (count(*) OVER before + 3.0), 0) AS g FROM a1
  WINDOW before AS (PARTITION BY goes ORDER BY hsh, sby_need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    _best_split("r1", "z", 3.0, 1e-12),
    "w2 AS (SELECT lng.v <= z.v AS goes, 0.5 * sum(g) / (count(*) + 3.0) AS w FROM r1 JOIN lng USING (date) JOIN z ON z.f = lng.f GROUP BY 1)",
    "t1 AS (SELECT lng.date, w FROM lng JOIN s ON s.f = lng.f JOIN w1 ON w1.goes = (lng.v <= s.v) WHERE is_test)",
    "t2 AS (SELECT lng.date, w FROM lng JOIN z ON z.f = lng.f JOIN w2 ON w2.goes = (lng.v <= z.v) WHERE is_test)") + """
SELECT date, ROUND(b + t1.w + t2.w, 4) AS prediction FROM t1 JOIN t2 USING (date), base""")
def q_oblivious_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of oblivious trees of one level (λ = 3, rate 0.5), the second on ordered residuals: test predictions."""
    return _scored(spark, sf_dir, B.Boosting("oblivious", 2, 0.5, depth=1, l2=3.0, ordered=True))


# --- L5 by series ------------------------------------------------------------------------------------------------

@register("l5_leafwise_segment")
def q_leafwise_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf-wise boosting with its library defaults, one model for each segment, fitted side by side: test metrics."""
    m = modeling(spark, sf_dir, segment=True, extended=True).where(f"date <= DATE '{TRAIN_END}'")
    m = cut_lineage(V.hash_split(m, ["series", "date"]))
    model = B.fit_boosting(m.where("not is_test"), L.ALL_FEATURES, B.PROFILES["LightGBM Regressor"], keys=["series"])
    return V.regression_metrics(B.score_boosting(model, m.where("is_test"), L.ALL_FEATURES, ["series"]), "sby_need", "prediction", ["series"])


# --- L9, L11: the reference's grid and feature counts -----------------------------------------------------------

@register("l9_grid_search")
def q_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 27 points of the boosting grid on five folds: 9 fits a fold, scored at 50, 100 and 200 rounds."""
    train, test = _split(spark, sf_dir)
    out = B.boosting_search(spark, train, test, L.HOLDOUT_FEATURES, ["Gradient Boosting Regressor"], [len(L.HOLDOUT_FEATURES)])
    return out.where("variant = 'tuned'").select("point", "params", "rounds", "cv_mse", "mse", "r2", "is_best")


@register("l11_feature_counts")
def q_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boosting libraries' defaults × all 11 feature counts, in importance order, selected by cross-validation."""
    train, test = _split(spark, sf_dir)
    ranked = L.top_features(L.importance(spark, train, L.ALL_FEATURES, max_depth=10), len(L.ALL_FEATURES))
    models = ["Gradient Boosting Regressor", "XGBoost Regressor", "LightGBM Regressor"]
    return B.boosting_search(spark, train, test, ranked, models, tune=False).drop("point", "variant")


# --- W6: folds of whole days over a pooled table ---------------------------------------------------------------

@register("w6_fold_ids_keyless", with_sql(S.daily_cte(SEGMENT), f"h AS (SELECT series, date FROM daily WHERE date <= DATE '{TRAIN_END}')",
                                          "d AS (SELECT date, count(*) AS here FROM h GROUP BY date)",
                                          """p AS (SELECT date, CAST(coalesce(sum(here) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b,
  CAST(sum(here) OVER () AS BIGINT) AS n FROM d)""") + """
SELECT h.series, h.date, CAST(CASE WHEN b < (n % 5) * (n // 5 + 1) THEN b // (n // 5 + 1)
  ELSE n % 5 + (b - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM h JOIN p USING (date)""")
def q_fold_ids_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily_ops(spark, sf_dir, SEGMENT, columns=[]).where(f"date <= DATE '{TRAIN_END}'").select("series", "date")
    return V.fold_ids(cut_lineage(d), 5)
