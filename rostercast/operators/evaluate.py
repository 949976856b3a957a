"""Model evaluation helpers.

Splits, folds and scaling are DataFrame expressions, so a split is a column,
not a materialised copy, and metrics are one aggregate per group.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostercast.functions.scalars import attach_scalars, join_on_keys


# --- V3 / D5: splits ------------------------------------------------------------------------------

def split_hash(key_cols: list[str], seed: int = 42) -> F.Column:
    """First 8 hex digits of ``md5(key | seed)``: a stable pseudo-random draw per row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8)


def hash_split(df: DataFrame, key_cols: list[str], test_fraction: float = 0.2, seed: int = 42,
               keys: list[str] | None = None, exact: bool = False, out_col: str = "is_test") -> DataFrame:
    """V3: deterministic 80/20 split that ignores time (the reference's random split).

    Default: a row is test when its hash is below ``test_fraction`` of the hash
    range — no shuffle, the same rows in every engine.  ``exact=True`` ranks
    the rows of each series by the hash and takes ``ceil(test_fraction · n)``
    (a window partitioned by the series keys).
    """
    h = split_hash(key_cols, seed)
    if not exact:
        if test_fraction >= 1.0:
            return df.withColumn(out_col, F.lit(True))
        threshold = format(int(max(test_fraction, 0.0) * 16 ** 8), "08x")
        return df.withColumn(out_col, h < F.lit(threshold))
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(h, *key_cols)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(out_col, F.row_number().over(w) <= F.ceil(n * F.lit(test_fraction)))


def chrono_split(df: DataFrame, test_fraction: float = 0.2, keys: list[str] | None = None,
                 date_col: str = "date", out_col: str = "is_test") -> DataFrame:
    """The last ``ceil(test_fraction · n)`` days of each series are the test set."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(F.col(date_col).desc())
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn(out_col, F.row_number().over(w) <= F.ceil(n * F.lit(test_fraction)))


# --- W6: contiguous folds ---------------------------------------------------------------------------

def day_positions(df: DataFrame, keys: list[str] | None = None, order_col: str = "date") -> DataFrame:
    """``(keys…, date, before, n)``: rows of the series before each day, and its rows in all.

    Prefix sums of per-day counts in two steps: months of a series (one array of month totals a series, bounded
    by the calendar), then days within their month.  No window ever spans a whole series.
    """
    keys = keys or []
    days = df.groupBy(*keys, order_col).agg(F.count(F.lit(1)).alias("_here")).withColumn("_month", F.trunc(order_col, "month"))
    months = days.groupBy(*keys, "_month").agg(F.sum("_here").alias("_sum"))
    series = months.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_month", "_sum"))).alias("_m"), F.sum("_sum").alias("n"))
    starts = series.select(*keys, "n", F.expr(
        "inline(transform(_m, (x, i) -> struct(x._month as _month, aggregate(slice(_m, 1, i), 0L, (a, y) -> a + y._sum) as _start)))"))
    earlier = Window.partitionBy(*keys, "_month").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = days.withColumn("_earlier", F.coalesce(F.sum("_here").over(earlier), F.lit(0)))
    return (join_on_keys(local, starts, [*keys, "_month"])
            .select(*keys, order_col, (F.col("_start") + F.col("_earlier")).alias("before"), "n"))


def fold_ids(df: DataFrame, k: int = 5, keys: list[str] | None = None, order_col: str = "date",
             out_col: str = "fold") -> DataFrame:
    """Unshuffled contiguous folds 0…k−1 of whole days; the first ``n mod k`` folds are one larger.

    A day belongs to the fold of its first row, so rows of one day are never
    dealt to two folds; with one row a day these are the folds of ``ntile``.
    """
    keys = keys or []
    q, r, at = F.expr(f"greatest(n div {k}, 1)"), F.expr(f"n % {k}"), F.col("before")
    fold = F.when(at < r * (F.expr(f"n div {k}") + 1), F.floor(at / (F.expr(f"n div {k}") + 1))).otherwise(r + F.floor((at - r * (q + 1)) / q))
    folds = day_positions(df, keys, order_col).select(*keys, order_col, fold.cast("int").alias(out_col))
    return join_on_keys(df, folds, [*keys, order_col])


def learning_sizes(n_train: int, start: float = 0.1, stop: float = 1.0, num: int = 5) -> list[int]:
    """V8: training sizes ``int(fraction · n_train)`` for evenly spaced fractions
    ``start … stop`` (computed as ``start + i · step`` with the end point exact)."""
    step = (stop - start) / (num - 1)
    fractions = [start + i * step for i in range(num - 1)] + [stop]
    return sorted({min(max(int(f * n_train), 1), n_train) for f in fractions})


# --- V4: standardisation ----------------------------------------------------------------------------

def fit_standardiser(train: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """V4 fit: population mean and std per column (and per series)."""
    keys = keys or []
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__mu"), F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd")]
    return train.groupBy(*keys).agg(*aggs) if keys else train.agg(*aggs)


def apply_standardiser(df: DataFrame, stats: DataFrame, cols: list[str], keys: list[str] | None = None,
                       suffix: str = "") -> DataFrame:
    """V4 transform: ``(x − μ) / σ`` with σ = 0 treated as 1 (scaler semantics).

    The statistics are one scalar row or one row per series (``attach_scalars``).
    """
    joined = attach_scalars(df, stats, keys)
    out = joined.withColumns({
        f"{c}{suffix}": (F.col(c).cast("double") - F.col(f"{c}__mu"))
        / F.coalesce(F.when(F.col(f"{c}__sd") != 0, F.col(f"{c}__sd")), F.lit(1.0))
        for c in cols})
    return out.drop(*[f"{c}__mu" for c in cols], *[f"{c}__sd" for c in cols])


def standardise_within(df: DataFrame, cols: list[str], train_cond: F.Column, keys: list[str] | None = None,
                       suffix: str = "") -> DataFrame:
    """V4 fit-and-apply in one pass: statistics of each series' training rows
    (``train_cond``) by a window partitioned by the series keys."""
    w = Window.partitionBy(*(keys or []))
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        mu = F.avg(F.when(train_cond, x)).over(w)
        sd = F.stddev_pop(F.when(train_cond, x)).over(w)
        out[f"{c}{suffix}"] = (x - mu) / F.coalesce(F.when(sd != 0, sd), F.lit(1.0))
    return df.withColumns(out)


def standardise(df: DataFrame, cols: list[str], train_cond: F.Column | None = None,
                keys: list[str] | None = None, suffix: str = "") -> DataFrame:
    """V4 entry point: fit on the training rows (``train_cond``, default all rows)
    and apply to every row, per series."""
    return standardise_within(df, cols, train_cond if train_cond is not None else F.lit(True), keys, suffix)


# --- V1 / V6: metrics --------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str = "y", pred: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """V1: MAE, MSE, RMSE, R² per group; R² is about the group's own mean.

    A constant target gives R² = 1 for a perfect fit and 0 otherwise.
    """
    by = by or []
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                F.var_pop(F.col(y).cast("double")).alias("_vy"))
    r2 = F.when(F.col("_vy") > 0, F.lit(1.0) - F.col("mse") / F.col("_vy")).otherwise(
        F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return out.select(*by, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def matched_metrics(truth: DataFrame, predicted: DataFrame, keys: list[str] | None = None, date_col: str = "date",
                    y: str = "y", pred: str = "prediction", by_keys: bool = True) -> DataFrame:
    """Truth and predictions joined on ``(keys…, date)``, with their metrics; days that only one side has raise.

    The reference compares by position; here a missing or a surplus day is an error and never a shorter comparison.
    """
    keys = keys or []
    on = [*keys, date_col]
    a = truth.select(*on, F.col(y).cast("double").alias("_y"), F.lit(1).alias("_a"))
    b = predicted.select(*on, F.col(pred).cast("double").alias("_p"), F.lit(1).alias("_b"))
    b = b.withColumnsRenamed({c: f"_right_{c}" for c in on})
    cond = [a[c].eqNullSafe(b[f"_right_{c}"]) for c in on]
    both = a.join(b, cond, "full").select(*[F.coalesce(c, f"_right_{c}").alias(c) for c in on], "_y", "_p", "_a", "_b")
    alone = F.col("_a").isNull() | F.col("_b").isNull()
    message = F.concat(F.lit("no counterpart on "), F.coalesce(F.col(date_col).cast("string"), F.lit("null")))
    checked = both.withColumn("_p", F.when(alone, F.raise_error(message)).otherwise(F.col("_p")).cast("double"))
    return regression_metrics(checked, "_y", "_p", keys if by_keys else None)


def residual_table(df: DataFrame, y: str, pred: str, keys: list[str] | None = None,
                   model: str | None = None, order_col: str = "date") -> DataFrame:
    """A5/V6: ``(model?, keys…, date, y, y_pred, residual)`` long table."""
    keys = keys or []
    cols = ([F.lit(model).alias("model")] if model else []) + [*map(F.col, keys), F.col(order_col),
                                                               F.col(y).cast("double").alias("y"),
                                                               F.col(pred).cast("double").alias("y_pred"),
                                                               (F.col(y) - F.col(pred)).cast("double").alias("residual")]
    return df.select(*cols)


def mse_ranking(metrics: DataFrame, name_col: str = "model") -> DataFrame:
    """V7/O1: model label cut at ``(`` and trimmed, ordered by MSE (ties by name)."""
    return (metrics.withColumn("label", F.trim(F.substring_index(F.col(name_col), "(", 1)))
            .orderBy("mse", "label"))


def predictions_wide(long: DataFrame, key_cols: list[str], models: list[str], model_col: str = "model",
                     pred_col: str = "prediction", suffix: str = "_pred") -> DataFrame:
    """One column ``<model>_pred`` per model beside the test-row keys.

    The long ``(keys…, model, prediction)`` table is pivoted with the model
    list given, so no extra job discovers the pivot values.
    """
    out = long.groupBy(*key_cols).pivot(model_col, models).agg(F.first(pred_col))
    return out.withColumnsRenamed({m: f"{m}{suffix}" for m in models})


def best_per_group(metrics: DataFrame, group: list[str], order: list[str], out_col: str = "rank") -> DataFrame:
    """O3: rank candidates per group; rank 1 is the strict arg-min (ties: order columns)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return metrics.withColumn(out_col, F.row_number().over(w))
