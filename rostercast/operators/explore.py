"""Exploration frames.

Plot-ready DataFrames instead of figures.  All operators accept optional
series keys; windows are always partitioned by them (never a global window
over many series).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostercast.functions.calendar import weekday_label
from rostercast.functions.scalars import attach_scalars


# --- G1: correlation matrix -----------------------------------------------------------------------

def pearson(x: str, y: str) -> F.Column:
    """Pairwise-complete Pearson correlation; NULL for a constant column.

    Written as covariance over the product of standard deviations of the rows
    where both values exist, because Spark's ``corr`` raises under ANSI mode
    when a variance is zero.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sa = F.stddev_pop(F.when(b.isNotNull(), a))
    sb = F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), sa * sb)


def corr_long(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long ``(keys…, x, y, r)`` with both triangles and the diagonal.

    Every row comes once for each column x and is aggregated by x, with one
    expression for each column y: the aggregate is as wide as the list of columns,
    not as their pairs, and after the map-side combine a task hands on one row for
    each column (and key).  An empty table has no correlations.
    """
    keys = keys or []
    values = [F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)]
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("_x")) for i in range(len(cols))]))
    long = df.select(*keys, *values).select("*", each)
    by_x = long.groupBy(*keys, "_i").agg(*[pearson("_x", f"_v{j}").alias(f"_r{j}") for j in range(len(cols))])
    upper = by_x.select(*keys, "_i", F.posexplode(F.array(*[f"_r{j}" for j in range(len(cols))])).alias("_j", "r")).where("_j >= _i")
    # a column's correlation with itself is 1, whatever the rounding; other pairs come both ways with the same value
    name = lambda i: F.element_at(F.array(*[F.lit(c) for c in cols]), F.col(i) + 1)
    pair = lambda i, j, r: F.struct(name(i).alias("x"), name(j).alias("y"), r.alias("r"))
    r = F.col("r")
    return upper.select(*keys, F.inline(F.when(F.col("_i") == F.col("_j"), F.array(pair("_i", "_j", F.when(r.isNotNull(), F.lit(1.0)))))
                                        .otherwise(F.array(pair("_i", "_j", r), pair("_j", "_i", r)))))


# --- G2-G6: group means and pivots ---------------------------------------------------------------------

def mean_by(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Mean of each value per group (hash aggregate, partial + final)."""
    return df.groupBy(*groups).agg(*[F.avg(v).alias(v) for v in values])


def weekday_means(df: DataFrame, values: list[str], keys: list[str] | None = None,
                  dow_col: str = "day_of_week") -> DataFrame:
    """Mean per weekday with its label Mo … So."""
    keys = keys or []
    return (mean_by(df, keys + [dow_col], values)
            .withColumn("weekday_label", weekday_label(dow_col)))


def pivot_mean(df: DataFrame, row: list[str] | str, col: str, pivot_values: list, values: list[str]) -> DataFrame:
    """Mean of each value, rows × pivot columns named ``<value>_<pivot>``.

    The pivot values are passed explicitly, so Spark runs no extra job to find
    them; absent cells are NULL.
    """
    rows = [row] if isinstance(row, str) else row
    out = df.groupBy(*rows).pivot(col, pivot_values).agg(*[F.avg(v).alias(v) for v in values])
    renames = {}
    for pv in pivot_values:
        for v in values:
            src = f"{pv}_{v}" if len(values) > 1 else f"{pv}"
            renames[src] = f"{v}_{pv}"
    return out.withColumnsRenamed(renames)


# --- W1-W5: additive decomposition -----------------------------------------------------------------

def decompose(df: DataFrame, measures: list[str], period: int = 30, keys: list[str] | None = None,
              date_col: str = "date") -> DataFrame:
    """Additive decomposition of each measure, by row position.

    * trend: centred moving average; an even period uses ``period + 1`` points
      with half weights at both ends; ``period // 2`` rows at each end are NULL;
    * seasonal: mean of the detrended values per phase ``position % period``,
      minus the mean of those phase means;
    * resid: observed − trend − seasonal.

    Measures are unpivoted first, so one window pass handles all of them; the
    window is partitioned by ``(keys…, measure)`` and the phase window reuses
    that partitioning (a sort, no new shuffle).
    """
    keys = keys or []
    part = keys + ["measure"]
    entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("observed")) for m in measures]
    long = df.select(*keys, date_col, F.inline(F.array(*entries)))
    w = Window.partitionBy(*part).orderBy(date_col)
    half = period // 2
    rows = w.rowsBetween(-half, half)
    x = F.col("observed")
    if period % 2 == 0:
        centred = (F.sum(x).over(rows) - 0.5 * F.lag(x, half).over(w) - 0.5 * F.lead(x, half).over(w)) / period
    else:
        centred = F.sum(x).over(rows) / period
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    pos = F.row_number().over(w) - 1
    staged = long.withColumns({"_pos": pos, "_n": n, "_c": centred})
    staged = staged.withColumn("trend", F.when((F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half),
                                               F.col("_c")))
    staged = staged.withColumn("_phase", F.col("_pos") % period)
    wp = Window.partitionBy(*part, "_phase")
    staged = staged.withColumns({"_pm": F.avg(x - F.col("trend")).over(wp),
                                 "_pc": F.count(F.lit(1)).over(wp)})
    wall = Window.partitionBy(*part)
    # mean of the phase means, each phase that has one counted once; fewer than two
    # whole periods do not tell trend from season: seasonal and resid are NULL
    weight = F.when(F.col("_pm").isNotNull(), 1 / F.col("_pc"))
    staged = staged.withColumn("_centre", F.sum(F.col("_pm") * weight).over(wall) / F.sum(weight).over(wall))
    staged = staged.withColumn("seasonal", F.when(F.col("_n") >= 2 * period, F.col("_pm") - F.col("_centre")))
    return staged.select(*keys, "measure", date_col, "observed", "trend", "seasonal",
                         (x - F.col("trend") - F.col("seasonal")).alias("resid"))


def row_position(df: DataFrame, keys: list[str] | None = None, order_col: str = "date",
                 out_col: str = "position") -> DataFrame:
    """0-based ordinal per series."""
    w = Window.partitionBy(*(keys or [])).orderBy(order_col)
    return df.withColumn(out_col, F.row_number().over(w) - 1)


# --- R8, R10, R11: panels, binned pairs, densities -----------------------------------------------------

def measure_panel(df: DataFrame, measures: list[str], keys: list[str] | None = None,
                  date_col: str = "date") -> DataFrame:
    """``(keys…, date, measure, value)``."""
    keys = keys or []
    entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    return df.select(*keys, date_col, F.inline(F.array(*entries)))


def binned_pairs(df: DataFrame, measures: list[str], bins: int = 20) -> DataFrame:
    """2-D histogram of every measure pair (i < j), bounded output.

    Bin edges come from a one-row min/max aggregate (a scalar subquery); each row is
    expanded into its pairs inside the map stage and immediately partially
    aggregated, so the shuffle carries at most ``pairs × bins²`` rows per task.
    """
    bounds = df.agg(*[F.min(F.col(m).cast("double")).alias(f"_lo_{m}") for m in measures],
                    *[F.max(F.col(m).cast("double")).alias(f"_hi_{m}") for m in measures])
    staged = attach_scalars(df.select(*measures), bounds)

    def bin_of(m: str) -> F.Column:
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        raw = F.floor(F.try_divide(F.col(m).cast("double") - lo, hi - lo) * bins)
        binned = F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1)))
        # least() skips NULLs, so a missing value must stay NULL explicitly
        return F.when(F.col(m).isNotNull(), binned).cast("int")

    entries = []
    for i, a in enumerate(measures):
        for b in measures[i + 1:]:
            entries.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                                    bin_of(a).alias("x_bin"), bin_of(b).alias("y_bin")))
    return (staged.select(F.inline(F.array(*entries)))
            .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
            .groupBy("x", "y", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def density(df: DataFrame, measures: list[str], grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per measure on a fixed grid (Scott bandwidth).

    Values are first reduced to ``(measure, value, weight)``.  Each distinct
    value row gets its measure's grid parameters (one row per measure: a
    broadcast bounded by the measure list) and generates its kernel weight at
    the ``grid`` points (a generator, no join of values with grid rows); the
    contributions are summed per grid point with partial aggregation.
    """
    entries = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    vals = (df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
            .groupBy("measure", "value").agg(F.count(F.lit(1)).alias("w")))
    stats = (vals.groupBy("measure")
             .agg(F.sum("w").alias("n"),
                  F.min("value").alias("lo"), F.max("value").alias("hi"),
                  F.sum(F.col("w") * F.col("value")).alias("s1"),
                  F.sum(F.col("w") * F.col("value") * F.col("value")).alias("s2")))
    stats = stats.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"))
                                                    / (F.col("n") - 1))))
    stats = (stats.withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
             .where(F.col("h") > 0).select("measure", "n", "lo", "hi", "h"))
    points = (vals.join(F.broadcast(stats), "measure")
              .select("measure", "value", "w", "n", "h", "lo", "hi",
                      F.posexplode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("gi", "_g"))
              .withColumn("x", F.col("lo") - cut * F.col("h")
                          + (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) * F.col("gi") / (grid - 1)))
    z = (F.col("x") - F.col("value")) / F.col("h")
    return (points.groupBy("measure", "gi", "x", "n", "h")
            .agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("_k"))
            .select("measure", "gi", "x",
                    (F.col("_k") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density")))
