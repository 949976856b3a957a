"""Entry point A.2: model search on the prepared history.

Training rows (fixed end date or the dynamic 14th) → 80/20 hash split →
linear baseline → importances → models × feature counts × {default, tuned} →
best per model → evaluation table, ranking, test-row predictions, residuals
and learning curves.  The split frame is checkpointed once; every fit is a
Spark ML job and the driver keeps only metric rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.functions.calendar import between_dates
from rostercast.operators import evaluate as V
from rostercast.operators import learn as L
from rostercast.plans.monthly import training_rows
from rostercast.session import right_sized


def model_search(spark: SparkSession, prepared: DataFrame, config: L.SearchConfig | None = None,
                 train_end: str | None = None, features: list[str] = L.ALL_FEATURES,
                 learning_curves: bool = True) -> dict[str, DataFrame]:
    """Returns ``results`` (model_evaluation_results), ``ranking`` (V7),
    ``candidates`` (every fit), ``predictions`` (J5 wide), ``residuals`` (V6)
    and ``learning_curves`` (V8, long with the model key)."""
    config = config or L.SearchConfig()
    data = between_dates(prepared, end=train_end) if train_end else training_rows(prepared)
    data = right_sized(V.hash_split(data, ["date"]))
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))

    base = L.fit(train, features, L.linear_baseline())
    preds = [L.score(base, test).select("date", F.col("sby_need").cast("double").alias("y"),
                                        F.lit("baseline").alias("model"), "prediction")]
    candidates = L.search(spark, train, test, config, features)
    best = candidates.where("is_best").collect()

    def refit(row):
        cand = L.CANDIDATES[row["model"]]
        # parameters travel as strings in the candidate table; restore their types
        params = {k: type(cand.defaults[k])(float(v)) for k, v in row["params"].items()}
        sel = list(row["selected_features"])
        model = L.fit(train, sel, cand.make(**params))
        pred = L.score(model, test).select("date", F.col("sby_need").cast("double").alias("y"),
                                           F.lit(row["key"]).alias("model"), "prediction")
        curve = None
        if learning_curves:
            curve = (L.learning_curve(spark, train, sel, lambda: cand.make(**params), parallelism=4)
                     .withColumn("model", F.lit(row["model"])))
        return pred, curve

    # the best models are independent: refit them (and their curves) side by side
    with ThreadPoolExecutor(max_workers=max(1, min(len(best), 2))) as pool:
        done = list(pool.map(refit, best))
    preds += [p for p, _ in done]
    curves = [c for _, c in done if c is not None]
    long = preds[0]
    for p in preds[1:]:
        long = long.unionByName(p)
    results = V.regression_metrics(long, "y", "prediction", ["model"])
    keys = ["baseline"] + [r["key"] for r in best]
    wide = V.predictions_wide(long, ["date", "y"], keys)
    residuals = long.select("model", "date", "y", F.col("prediction").alias("y_pred"),
                            (F.col("y") - F.col("prediction")).alias("residual"))
    out = {"results": results, "ranking": V.mse_ranking(results), "candidates": candidates,
           "predictions": wide, "residuals": residuals}
    if curves:
        lc_all = curves[0]
        for c in curves[1:]:
            lc_all = lc_all.unionByName(c)
        out["learning_curves"] = lc_all
    return out
