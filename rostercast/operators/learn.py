"""Learners, feature selection, search and persistence.

Everything is Spark ML: ``VectorAssembler`` → ``StandardScaler`` → regressor
in one ``Pipeline``, so the scaler always travels with the model (D7, D12) and
a saved ``PipelineModel`` scores with the scaler it was fitted with.  Tree
training is Spark's distributed histogram algorithm; the driver loops only
over candidates (a handful of metric rows are all it holds).

The boosted-tree libraries of the reference are not available; their
candidates are re-aimed as profiles of ``GBTRegressor`` (documented in the
README), so their numbers will not match the reference's table.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostercast.functions.scalars import join_on_keys
from rostercast.operators.evaluate import day_positions, fold_ids, learning_sizes, regression_metrics
from rostercast.session import cut_lineage

# The feature list of the reference's model search (this order), the
# holdout-evaluation order and the production order.
ALL_FEATURES = ["n_duty", "month", "day_of_week", "season", "week", "holiday", "year", "n_sick", "day",
                "week_of_month", "calls"]
HOLDOUT_FEATURES = ["calls", "n_duty", "year", "n_sick"]
PROD_FEATURES = ["calls", "year", "n_duty", "n_sick"]
TARGET = "sby_need"
SEED = 42


@dataclass(frozen=True)
class Candidate:
    """A learner profile: default parameters and the search grid."""

    name: str
    make: Callable[..., object]
    defaults: dict
    grid: dict = field(default_factory=dict)


# Spark bins continuous features; the reference's learners split on exact values.
# 256 bins keeps high-cardinality inputs such as `calls` close to exact splits.
MAX_BINS = 256


def _rf(**kw):
    return RandomForestRegressor(seed=SEED, featureSubsetStrategy="all", **{"maxBins": MAX_BINS, **kw})


def _gbt(**kw):
    return GBTRegressor(seed=SEED, **{"maxBins": MAX_BINS, **kw})


def leaves_to_depth(leaves: int) -> int:
    """LightGBM leaf counts mapped to a depth with at least that many leaves."""
    return int(math.ceil(math.log2(leaves)))


# Grids of the reference's search (n_estimators / learning rate / depth or
# leaves / iterations); defaults follow each library's documented defaults, with
# unlimited forest depth as Spark's own limit of 30.
CANDIDATES = {
    "Random Forest Regressor": Candidate(
        "Random Forest Regressor", _rf, {"numTrees": 100, "maxDepth": 30},
        {"numTrees": [50, 100, 200], "maxDepth": [3, 4, 5]}),
    "Gradient Boosting Regressor": Candidate(
        "Gradient Boosting Regressor", _gbt, {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
        {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 4, 5]}),
    "XGBoost Regressor": Candidate(
        "XGBoost Regressor", _gbt, {"maxIter": 100, "stepSize": 0.3, "maxDepth": 6},
        {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 4, 5]}),
    "LightGBM Regressor": Candidate(
        "LightGBM Regressor", _gbt, {"maxIter": 100, "stepSize": 0.1, "maxDepth": leaves_to_depth(31)},
        {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.05, 0.1],
         "maxDepth": [leaves_to_depth(x) for x in (31, 50, 100)]}),
    "CatBoost Regressor": Candidate(
        "CatBoost Regressor", _gbt, {"maxIter": 1000, "stepSize": 0.03, "maxDepth": 6},
        {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 4, 5]}),
}
# production model: gradient boosting, depth 4, 200 trees
PROD_PARAMS = {"maxIter": 200, "maxDepth": 4, "stepSize": 0.1}


def linear_baseline() -> LinearRegression:
    """L1: ordinary least squares (no penalty) on the scaled features."""
    return LinearRegression(solver="normal", regParam=0.0, elasticNetParam=0.0)


def pipeline(features: list[str], estimator, scale: bool = True, label: str = TARGET) -> Pipeline:
    """Assembler (by name, in the given order) → scaler → learner."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    estimator.setFeaturesCol("features").setLabelCol("_label").setPredictionCol("prediction")
    stages.append(estimator)
    return Pipeline(stages=stages)


def with_label(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.withColumn("_label", F.col(label).cast("double"))


def fit(df: DataFrame, features: list[str], estimator, label: str = TARGET, scale: bool = True) -> PipelineModel:
    """Fit the pipeline on ``df``."""
    return pipeline(features, estimator, scale, label).fit(with_label(df, label))


def score(model: PipelineModel, df: DataFrame, label: str | None = TARGET) -> DataFrame:
    """``transform`` keeps every input column and appends ``prediction``."""
    out = model.transform(with_label(df, label) if label and label in df.columns else df)
    return out.drop("_raw", "features", "_label")


def save_model(model: PipelineModel, path: str) -> None:
    """Scaler and learner saved together as one pipeline directory."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """S6."""
    return PipelineModel.load(path)


# --- L7 / L8: importance and selection --------------------------------------------------------------

def importance(spark: SparkSession, train: DataFrame, features: list[str], label: str = TARGET,
               num_trees: int = 100, max_depth: int = 30) -> DataFrame:
    """Forest importances on unscaled features, ``(feature, importance, rank)`` sorted desc."""
    model = fit(train, features, _rf(numTrees=num_trees, maxDepth=max_depth), label, scale=False)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return rank_importances(spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double"))


def rank_importances(importances: DataFrame) -> DataFrame:
    """O1: ``(feature, importance, rank)``, the largest first, ties by name (a row for each feature)."""
    w = Window.orderBy(F.col("importance").desc_nulls_last(), "feature")
    return importances.select("feature", "importance", F.row_number().over(w).alias("rank"))


def top_features(importances: DataFrame, n: int) -> list[str]:
    """The ``n`` most important features (importance order)."""
    return [r["feature"] for r in importances.where(F.col("rank") <= n).orderBy("rank").collect()]


# --- L9: grid search with contiguous folds -----------------------------------------------------------

def grid_search(train: DataFrame, features: list[str], candidate: Candidate, label: str = TARGET,
                k: int = 5, parallelism: int = 4, grid: dict | None = None):
    """``CrossValidator`` over the candidate's grid with unshuffled folds.

    Returns ``(best PipelineModel, best params dict, mean CV MSE per grid point)``.
    """
    grid = grid if grid is not None else candidate.grid
    est = candidate.make(**candidate.defaults)
    pipe = pipeline(features, est, True, label)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    maps = builder.build()
    # every grid point re-reads the folds k times: materialise them once
    data = cut_lineage(fold_ids(cut_lineage(with_label(train, label)), k, order_col="date", out_col="_fold"))
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, numFolds=k, foldCol="_fold",
                        evaluator=RegressionEvaluator(labelCol="_label", predictionCol="prediction", metricName="mse"),
                        parallelism=parallelism, seed=SEED)
    cvm = cv.fit(data)
    metrics = [float(x) for x in cvm.avgMetrics]
    best_i = min(range(len(metrics)), key=lambda i: (metrics[i], i))
    best = {p.name: v for p, v in maps[best_i].items()}
    return cvm.bestModel, best, metrics


# --- L10 / L11 / O3 / U1: model search ------------------------------------------------------------------

@dataclass
class SearchConfig:
    models: list[str] = field(default_factory=lambda: list(CANDIDATES))
    feature_counts: list[int] = field(default_factory=lambda: list(range(1, len(ALL_FEATURES) + 1)))
    tune: bool = True
    grids: dict | None = None          # per model grids (reduced plans); None = the reference's full grids
    defaults: dict | None = None       # per model override of the default parameters
    select_on: str = "cv"              # "cv", or "test" as the reference selects
    importance_trees: int = 100
    parallelism: int = 4               # candidate fits submitted concurrently from the driver


def search(spark: SparkSession, train: DataFrame, test: DataFrame, config: SearchConfig,
           features: list[str] = ALL_FEATURES, label: str = TARGET) -> DataFrame:
    """Every model × feature count × {default, tuned}; best per model.

    Importances are fitted once and sliced per count (the reference refits the
    same forest for every count).  Candidate fits are independent Spark jobs
    submitted from ``config.parallelism`` driver threads.  Returns one immutable row per candidate fit
    ``(model, n_features, selected_features, variant, params, mae, mse, rmse,
    r2, cv_mse, is_best)`` — the driver keeps only these metric rows.
    """
    imp = importance(spark, train, features, label, num_trees=config.importance_trees)
    order = top_features(imp, len(features))

    def run(task):
        name, n = task
        cand = CANDIDATES[name]
        defaults = (config.defaults or {}).get(name, cand.defaults)
        # an explicit grids mapping restricts tuning to the models it names
        grid = config.grids.get(name, {}) if config.grids is not None else cand.grid
        sel = order[:n]
        if config.select_on == "cv":
            # the untuned candidate is scored on the same folds: a grid of its own parameters
            first = next(iter(defaults))
            model, _, cv = grid_search(train, sel, Candidate(name, cand.make, defaults), label, grid={first: [defaults[first]]})
            variants = [("default", model, defaults, cv[0])]
        else:
            variants = [("default", fit(train, sel, cand.make(**defaults), label), defaults, None)]
        if config.tune and grid:
            best_model, best_params, cv = grid_search(train, sel, Candidate(name, cand.make, defaults, grid), label)
            variants.append(("tuned", best_model, {**defaults, **best_params}, float(min(cv))))
        out = []
        for variant, model, params, cv_mse in variants:
            m = regression_metrics(score(model, test, label), label, "prediction").first()
            out.append((name, n, sel, variant, {k: str(v) for k, v in params.items()},
                        m["mae"], m["mse"], m["rmse"], m["r2"], cv_mse))
        return out

    tasks = [(name, n) for name in config.models for n in config.feature_counts]
    with ThreadPoolExecutor(max_workers=max(1, config.parallelism)) as pool:
        rows = [r for chunk in pool.map(run, tasks) for r in chunk]
    res = spark.createDataFrame(rows, "model string, n_features int, selected_features array<string>, "
                                      "variant string, params map<string,string>, mae double, mse double, "
                                      "rmse double, r2 double, cv_mse double")
    return mark_best(res, "mse" if config.select_on == "test" else "cv_mse")


def mark_best(candidates: DataFrame, criterion: str) -> DataFrame:
    """``candidates`` with ``is_best`` and ``key``: the strict arg-min of each model.

    Ties go to fewer features, then to the default before the tuned variant; a missing criterion loses.
    """
    w = Window.partitionBy("model").orderBy(F.col(criterion).asc_nulls_last(), "n_features",
                                            F.when(F.col("variant") == "default", 0).otherwise(1))
    return (candidates.withColumn("is_best", F.row_number().over(w) == 1)
            .withColumn("key", F.concat(F.col("model"), F.lit(" ("), F.col("n_features").cast("string"), F.lit(" features)"))))


def stack_results(results: dict[str, DataFrame]) -> DataFrame:
    """The metric rows of several models as one table, the model's name in front."""
    out = None
    for name, rows in results.items():
        named = rows.select(F.lit(name).alias("model"), "*")
        out = named if out is None else out.unionByName(named)
    return out


# --- V8: learning curve -------------------------------------------------------------------------------

def learning_curve(spark: SparkSession, train: DataFrame, features: list[str], make_estimator: Callable[[], object],
                   k: int = 5, label: str = TARGET, parallelism: int = 8) -> DataFrame:
    """V8: for each validation fold and size, fit on the first ``size`` rows (date order)
    of the other folds; mean train / validation MSE per size.

    The frame is checkpointed once (shared checkpoint folder) before the
    ``k × sizes`` fits, which are independent Spark jobs submitted from
    ``parallelism`` driver threads (as ``CrossValidator`` does).  Folds and
    positions come from prefix sums of per-day counts, days are taken whole; each fit's training
    prefix is a plain filter.  Returns ``(train_size, train_mse, val_mse)``.
    """
    train = cut_lineage(with_label(train, label))
    ordered = fold_ids(train, k, order_col="date", out_col="_fold")
    data = cut_lineage(join_on_keys(ordered, day_positions(train).select("date", F.col("before").alias("_pos")), ["date"]))
    # fold sizes are k numbers: the prefix of "all other folds in date order" then
    # becomes a filter on the global position, with no window per fit
    sizes_by_fold = dict(data.groupBy("_fold").count().collect())
    n = sum(sizes_by_fold.values())
    max_train = n - math.ceil(n / k)
    sizes = learning_sizes(max_train)

    def one(task):
        s, f = task
        start = sum(sizes_by_fold.get(i, 0) for i in range(f))
        width = sizes_by_fold.get(f, 0)
        rest_pos = F.when(F.col("_pos") >= start + width, F.col("_pos") - width).otherwise(F.col("_pos"))
        part = data.where((F.col("_fold") != f) & (rest_pos < s))
        model = pipeline(features, make_estimator(), True, label).fit(part)
        tr = regression_metrics(score(model, part, label), label, "prediction").first()["mse"]
        va = regression_metrics(score(model, data.where(F.col("_fold") == f), label), label, "prediction").first()["mse"]
        return s, tr, va

    tasks = [(s, f) for s in sizes for f in range(k)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(one, tasks))
    out = []
    for s in sizes:
        got = [r for r in results if r[0] == s]
        out.append((s, sum(r[1] for r in got) / k, sum(r[2] for r in got) / k))
    return spark.createDataFrame(out, "train_size int, train_mse double, val_mse double")


def grid_points(grid: dict) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in product(*[grid[k] for k in keys])]
