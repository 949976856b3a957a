"""Forecasting of the unknown inputs.

The reference fits a Bayesian structural model (piecewise-linear trend,
Fourier seasonalities, extra regressors) per input series.  Here the same
structure is fitted to its posterior maximum:

* every basis column is a Spark expression (F5 Fourier terms, F6 trend hinges,
  standardised regressors), so design matrices are built where the data lives;
* trend changes have a Laplace prior: an L1 penalty, solved by coordinate descent on
  the normal equations, so most changes are exactly 0; the other columns have
  Gaussian priors (the intercept a flat one).  The noise variance is re-estimated once;
* additive mode is one linear solve.  Multiplicative mode fits
  ``trend * (1 + seasonality + regressors)`` itself: both parts are solved together,
  linearised at the present ones, until the posterior no longer improves;
* the solve needs nothing but moments of the basis (``XᵀX``, ``Xᵀy``, at most about 120 columns).
  With keys they are taken per series in ``groupBy(keys).applyInPandas``: a group is one series'
  daily history, bounded by the number of days.  Without keys every task sums the moments of its
  own rows, and only those sums meet;
* prediction is a Spark-side dot product of the same basis with the
  coefficients (``zip_with`` + ``aggregate``), so scoring stays JVM-side.

Intervals hold the residual noise and the trend changes that may yet come: at the history's rate
and mean size, their variance grows with the cube of the time since the history's end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostercast.functions.scalars import attach_scalars, join_on_keys
from rostercast.session import cut_lineage

EPOCH = "1970-01-01"
FAR = 1.0e9  # padding for missing changepoints: the hinge stays 0


@dataclass(frozen=True)
class Seasonality:
    name: str
    period: float
    order: int
    prior_scale: float | None = None


@dataclass(frozen=True)
class ForecastSpec:
    mode: str = "additive"
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    regressor_prior_scale: float = 10.0
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    seasonalities: tuple[Seasonality, ...] = (Seasonality("yearly", 365.25, 10), Seasonality("weekly", 7.0, 3))
    regressors: tuple[str, ...] = ()
    interval_width: float = 0.8
    noise_sd: float = 0.1
    trend_prior_scale: float = 5.0


# The two input forecasts of the reference.
#   calls: multiplicative, changepoint scale 0.9, seasonality scale 15, 95 % interval,
#          extra monthly seasonality period 30.5 order 26, regressors holiday, month,
#          season, day_of_week, year, week_of_month (automatic yearly 10 / weekly 3 kept)
#   n_sick: additive, changepoint scale 0.35, yearly period 365.25 order 1 (replaces the
#          automatic yearly term), weekly 3, regressors day_of_week, holiday, month,
#          season, 80 % interval
CALLS_SPEC = ForecastSpec(mode="multiplicative", changepoint_prior_scale=0.9, seasonality_prior_scale=15.0,
                          interval_width=0.95,
                          seasonalities=(Seasonality("yearly", 365.25, 10), Seasonality("weekly", 7.0, 3),
                                         Seasonality("monthly", 30.5, 26)),
                          regressors=("holiday", "month", "season", "day_of_week", "year", "week_of_month"))
SICK_SPEC = ForecastSpec(mode="additive", changepoint_prior_scale=0.35,
                         seasonalities=(Seasonality("yearly", 365.25, 1), Seasonality("weekly", 7.0, 3)),
                         regressors=("day_of_week", "holiday", "month", "season"))


# --- F5: Fourier terms ------------------------------------------------------------------------------

def days_since_epoch(ds: Column | str) -> Column:
    d = F.col(ds) if isinstance(ds, str) else ds
    return F.datediff(d, F.lit(EPOCH).cast("date")).cast("double")


def fourier_terms(ds: Column | str, period: float, order: int) -> list[Column]:
    """``[sin(2πkt/P), cos(2πkt/P)]`` for k = 1…order, t in days since epoch."""
    t = days_since_epoch(ds)
    out = []
    for k in range(1, order + 1):
        arg = F.lit(2.0 * math.pi * k) * t / F.lit(float(period))
        out += [F.sin(arg), F.cos(arg)]
    return out


def fourier_long(df: DataFrame, seasonalities: tuple[Seasonality, ...], date_col: str = "date") -> DataFrame:
    """F5 as a long table ``(…, component, k, sin, cos)``."""
    entries = []
    for s in seasonalities:
        terms = fourier_terms(date_col, s.period, s.order)
        for k in range(1, s.order + 1):
            entries.append(F.struct(F.lit(s.name).alias("component"), F.lit(k).alias("k"),
                                    terms[2 * k - 2].alias("sin"), terms[2 * k - 1].alias("cos")))
    return df.select("*", F.inline(F.array(*entries)))


# --- F6: trend basis ---------------------------------------------------------------------------------

def changepoints(history: DataFrame, keys: list[str], ds: str = "ds", n_changepoints: int = 25,
                 changepoint_range: float = 0.8) -> DataFrame:
    """candidate changepoint dates per series.

    Positions ``round_half_even(j · (h−1)/n)`` for j = 1…n over the first
    ``h = floor(changepoint_range · rows)`` rows (evenly spaced over the early
    history).  Returns ``(keys…, cp_dates array<date>)``; at most
    ``n_changepoints`` entries per series.
    """
    if n_changepoints <= 0:
        # no trend changes: one row per series without changepoint dates
        return (history.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                .select(*keys, F.lit(None).cast("array<date>").alias("cp_dates")))
    w = Window.partitionBy(*keys).orderBy(ds)
    staged = history.select(*keys, ds).withColumns({
        "_pos": F.row_number().over(w) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    hs = F.floor(F.col("_n") * F.lit(changepoint_range))
    step = (hs - 1) / F.lit(float(n_changepoints))
    positions = F.transform(F.sequence(F.lit(1), F.lit(n_changepoints)), lambda j: F.bround(j * step, 0).cast("long"))
    picked = staged.where((hs > 1) & F.array_contains(positions, F.col("_pos")))
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_set(ds)).alias("cp_dates"))


def _time_and_hinges(ds: str, n_changepoints: int) -> tuple[Column, list[Column]]:
    """``t`` scaled to the series' history (columns ``_ds0``, ``_ds1``) and the hinge
    columns at ``cp_dates``; missing changepoints give a constant 0 hinge."""
    span = F.greatest(F.datediff(F.col("_ds1"), F.col("_ds0")).cast("double"), F.lit(1.0))
    t = F.datediff(F.col(ds), F.col("_ds0")).cast("double") / span
    cp_t = F.transform(F.coalesce(F.col("cp_dates"), F.array().cast("array<date>")),
                       lambda c: F.datediff(c, F.col("_ds0")).cast("double") / span)
    hinges = [F.greatest(t - F.coalesce(F.try_element_at(cp_t, F.lit(j + 1)), F.lit(FAR)), F.lit(0.0))
              for j in range(n_changepoints)]
    return t, hinges


def trend_basis(df: DataFrame, history: DataFrame, keys: list[str] | None = None, ds: str = "ds",
                n_changepoints: int = 25, changepoint_range: float = 0.8) -> DataFrame:
    """F6 as columns: scaled time ``t`` (0 at the first, 1 at the last history day
    of the series) and hinges ``cp_j = max(t − t_j, 0)`` at the changepoints.

    The per-series parameters (first/last day, changepoint dates) are one row
    per series, attached by ``attach_scalars``.
    """
    keys = keys or []
    bounds = history.groupBy(*keys).agg(F.min(ds).alias("_ds0"), F.max(ds).alias("_ds1"))
    cps = changepoints(history, keys, ds, n_changepoints, changepoint_range)
    params = attach_scalars(bounds, cps, keys)
    staged = attach_scalars(df, params, keys)
    t, hinges = _time_and_hinges(ds, n_changepoints)
    cols = {"t": t, **{f"cp_{j + 1}": h for j, h in enumerate(hinges)}}
    return staged.withColumns(cols).drop("_ds0", "_ds1", "cp_dates")


# --- fit parameters per series --------------------------------------------------------------------

def _series_params(history: DataFrame, keys: list[str], spec: ForecastSpec, ds: str, y: str) -> DataFrame:
    yv = F.col(y).cast("double")
    aggs = [F.min(ds).alias("_ds0"), F.max(ds).alias("_ds1"), F.max(F.abs(yv)).alias("_yscale")]
    for r in spec.regressors:
        x = F.col(r).cast("double")
        aggs += [F.avg(x).alias(f"_mu_{r}"), F.stddev_samp(x).alias(f"_sd_{r}"),
                 F.count_if(~x.isin(0.0, 1.0)).alias(f"_nb_{r}")]
    base = history.groupBy(*keys).agg(*aggs)
    cps = changepoints(history, keys, ds, spec.n_changepoints, spec.changepoint_range)
    return attach_scalars(base, cps, keys)


def _design(df: DataFrame, params: DataFrame, keys: list[str], spec: ForecastSpec, ds: str) -> DataFrame:
    """Attach the basis column ``_x`` (array<double>) using per-series parameters."""
    joined = attach_scalars(df, params, keys)
    t, hinges = _time_and_hinges(ds, spec.n_changepoints)
    seas = []
    for s in spec.seasonalities:
        seas += fourier_terms(F.col(ds), s.period, s.order)
    regs = []
    for r in spec.regressors:
        x = F.col(r).cast("double")
        binary = F.col(f"_nb_{r}") == 0
        sd = F.coalesce(F.when(F.col(f"_sd_{r}") > 0, F.col(f"_sd_{r}")), F.lit(1.0))
        regs.append(F.when(binary, x).otherwise((x - F.col(f"_mu_{r}")) / sd))
    return joined.withColumn("_x", F.array(F.lit(1.0), t, *hinges, *seas, *regs))


# --- the posterior maximum from moments ---------------------------------------------------------------

@dataclass
class Moments:
    """Sums over rows of a linear model ``target ~ J``: ``JᵀJ``, ``Jᵀtarget``, ``targetᵀtarget``, squared residuals at the given coefficients, rows."""

    gram: np.ndarray
    cross: np.ndarray
    square: float
    sse: float
    n: float


def _prior_scales(spec: ForecastSpec) -> np.ndarray:
    """Prior scale of every basis column: standard deviations, and the Laplace scale of trend changes (intercept: flat)."""
    scales = [np.inf, spec.trend_prior_scale]
    scales += [spec.changepoint_prior_scale] * spec.n_changepoints
    for s in spec.seasonalities:
        scales += [s.prior_scale or spec.seasonality_prior_scale] * (2 * s.order)
    scales += [spec.regressor_prior_scale] * len(spec.regressors)
    return np.asarray(scales, dtype=float)


def linearised(X: np.ndarray, y: np.ndarray, coef: np.ndarray, spec: ForecastSpec) -> np.ndarray:
    """``[J, target, residual]`` of the model at ``coef``; solving ``target ~ J`` gives the next coefficients.

    Additive: J is X and the target y.  Multiplicative: the derivative of
    ``trend * (1 + rest)`` by the coefficients, its trend columns times ``1 + rest``
    and its other columns times the trend.
    """
    if spec.mode != "multiplicative":
        return np.column_stack([X, y, y - X @ coef])
    k = 2 + spec.n_changepoints
    trend, rest = X[:, :k] @ coef[:k], X[:, k:] @ coef[k:]
    J = np.column_stack([X[:, :k] * (1.0 + rest)[:, None], X[:, k:] * trend[:, None]])
    residual = y - trend * (1.0 + rest)
    return np.column_stack([J, residual + J @ coef, residual])


def moments_of(Z: np.ndarray, n: float) -> Moments:
    """From ``ZᵀZ`` of :func:`linearised` and the number of rows."""
    return Moments(Z[:-2, :-2], Z[:-2, -2], float(Z[-2, -2]), float(Z[-1, -1]), n)


def lasso(Q: np.ndarray, r: np.ndarray, penalty: float, start: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """``argmin ½ dᵀQd − rᵀd + penalty·|d|₁`` by coordinate descent.

    Every few sweeps the signs found are tried: the linear system of the columns that are
    not 0 gives the exact minimum when its signs and the gradients of the others agree.
    Columns without variance stay 0.
    """
    diag = np.diag(Q)
    live = np.flatnonzero(diag > 1e-12 * max(float(diag.max(initial=0.0)), 1e-300))
    d = np.zeros(len(r))
    d[live] = start[live]
    gradient = r - Q @ d
    for sweep in range(sweeps):
        moved = 0.0
        for j in live:
            z = gradient[j] + diag[j] * d[j]
            step = math.copysign(max(abs(z) - penalty, 0.0), z) / diag[j] - d[j]
            if step:
                d[j] += step
                gradient = gradient - Q[:, j] * step
                moved = max(moved, abs(step) * math.sqrt(diag[j]))
        if sweep % 10 == 9 or moved <= 1e-14:
            on = np.flatnonzero(d)
            exact = np.zeros(len(r))
            if len(on):
                exact[on] = np.linalg.lstsq(Q[np.ix_(on, on)], r[on] - penalty * np.sign(d[on]), rcond=None)[0]
            rest = np.setdiff1d(live, on)
            g = r - Q @ exact
            if (np.sign(exact[on]) == np.sign(d[on])).all() and (np.abs(g[rest]) <= penalty * (1 + 1e-9) + 1e-15).all():
                return exact
        if moved <= 1e-14:
            break
    return d


def posterior_maximum(m: Moments, spec: ForecastSpec, sigma2: float, start: np.ndarray) -> np.ndarray:
    """Coefficients that minimise ``|target − Jβ|² / 2σ²`` and the priors' penalties.

    The columns with Gaussian priors are eliminated (Schur complement); what is left
    is an L1 problem in the trend changes.
    """
    scales = _prior_scales(spec)
    laplace = np.arange(len(scales))[2:2 + spec.n_changepoints]
    smooth = np.setdiff1d(np.arange(len(scales)), laplace)
    A = m.gram[np.ix_(smooth, smooth)] + np.diag(sigma2 / scales[smooth] ** 2)
    coef = np.zeros(len(scales))
    if not len(laplace):
        coef[smooth] = np.linalg.solve(A, m.cross[smooth])
        return coef
    mixed = m.gram[np.ix_(smooth, laplace)]
    solved = np.linalg.solve(A, np.column_stack([mixed, m.cross[smooth]]))
    Q = m.gram[np.ix_(laplace, laplace)] - mixed.T @ solved[:, :-1]
    r = m.cross[laplace] - mixed.T @ solved[:, -1]
    coef[laplace] = lasso((Q + Q.T) / 2, r, sigma2 / spec.changepoint_prior_scale, start[laplace])
    coef[smooth] = solved[:, -1] - solved[:, :-1] @ coef[laplace]
    return coef


def penalty(coef: np.ndarray, spec: ForecastSpec) -> float:
    """Minus the logarithm of the priors at ``coef``, up to a constant."""
    k = 2 + spec.n_changepoints
    scaled = coef / _prior_scales(spec)
    return float((np.delete(scaled, np.s_[2:k]) ** 2).sum() / 2 + np.abs(scaled[2:k]).sum())


def fit_moments(moments: Callable[[np.ndarray], Moments], spec: ForecastSpec, most: int = 40) -> tuple[np.ndarray, float, float, float]:
    """``(coefficients, residual sd, noise sd the priors were weighed with, rows)``.

    σ starts at ``noise_sd`` (scaled units) and is then re-estimated from the residuals of the
    first solution (one refinement step), so the priors weigh against the noise the series
    actually has.  ``moments`` gives the moments at given coefficients.
    """
    coef, sigma2 = np.zeros(len(_prior_scales(spec))), spec.noise_sd ** 2
    here = moments(coef)
    for _ in range(2):
        used = sigma2
        if spec.mode != "multiplicative":
            coef = posterior_maximum(here, spec, sigma2, coef)
            sse = here.square - 2 * coef @ here.cross + coef @ here.gram @ coef
        else:
            value = here.sse / (2 * sigma2) + penalty(coef, spec)
            for _ in range(most):
                step = posterior_maximum(here, spec, sigma2, coef) - coef
                length, better = 1.0, False
                while length > 1e-3 and not better:
                    there = moments(coef + length * step)
                    new = there.sse / (2 * sigma2) + penalty(coef + length * step, spec)
                    better = new <= value
                    length /= 2
                if not better:
                    break
                gain, value = value - new, new
                coef, here = coef + 2 * length * step, there
                if gain <= 1e-10 * max(abs(value), 1.0):
                    break
            sse = here.sse
        sigma2 = max(float(sse) / here.n, 1e-12)
    return coef, math.sqrt(sigma2), math.sqrt(used), here.n


def _series_solver(keys: list[str], spec: ForecastSpec):
    """The fit of one series whose basis rows are in memory (its daily history)."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        X = np.vstack(pdf["_x"].to_numpy())
        y = pdf["_ys"].to_numpy(dtype=float)

        def moments(coef: np.ndarray) -> Moments:
            Z = linearised(X, y, coef, spec)
            return moments_of(Z.T @ Z, len(y))

        coef, sd, noise, n = fit_moments(moments, spec)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out.update({"coef": [coef.tolist()], "resid_sd": [sd], "noise_sd": [noise], "n_obs": [int(n)]})
        return pd.DataFrame(out)
    return solve


MOMENT_GROUPS = 32


def summed_moments(design: DataFrame, spec: ForecastSpec, coef: np.ndarray, grouped: bool) -> Moments:
    """Moments over all rows of ``design`` ``(_x, _ys)`` as a distributed sum.

    Every task sums its own rows to one matrix; with ``grouped`` (more than ``MOMENT_GROUPS`` tasks)
    Spark sums those of ``MOMENT_GROUPS`` groups.  That many matrices of at most about 120 columns reach the driver.
    """
    p = len(coef) + 2

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((p, p)), 0
        for batch in batches:
            if batch.num_rows:
                X = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                Z = linearised(X, batch.column(1).to_numpy(), coef, spec)
                total, n = total + Z.T @ Z, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(pdf["n"].sum())], "sums": [np.sum(np.vstack(pdf["sums"].to_numpy()), axis=0).tolist()]})

    parts = design.select("_x", "_ys").mapInArrow(of_task, "n long, sums array<double>")
    if grouped:
        parts = (parts.withColumn("group", F.spark_partition_id() % MOMENT_GROUPS).groupBy("group")
                 .applyInPandas(of_group, "n long, sums array<double>"))
    rows = parts.collect()
    return moments_of(np.sum([np.asarray(r["sums"]) for r in rows], axis=0).reshape(p, p), sum(r["n"] for r in rows))


@dataclass
class ForecastModel:
    """A fitted per-series forecast: parameters + coefficients, both DataFrames."""

    spec: ForecastSpec
    keys: list[str]
    params: DataFrame
    ds: str = "ds"


FITTED = [T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("resid_sd", T.DoubleType()),
          T.StructField("noise_sd", T.DoubleType()), T.StructField("n_obs", T.LongType())]


def fit_forecast(history: DataFrame, spec: ForecastSpec, keys: list[str] | None = None,
                 ds: str = "ds", y: str = "y") -> ForecastModel:
    """fit one structural model per series (eager, like an estimator's ``fit``).

    Without keys the whole history is one series: its moments are a distributed sum and
    the small solve runs on the result.
    """
    keys = list(keys or [])
    # the history is read by the parameter aggregate, the changepoint window and the
    # design join: materialise the (series × days) frame once in the shared folder
    history = cut_lineage(history.select(*keys, ds, y, *spec.regressors))
    params = _series_params(history, keys, spec, ds, y)
    design = _design(history.where(F.col(y).isNotNull()), params, keys, spec, ds)
    design = design.withColumn("_ys", F.col(y).cast("double") / F.coalesce(F.when(F.col("_yscale") > 0, F.col("_yscale")), F.lit(1.0)))
    if keys:
        types = {f.name: f.dataType for f in design.schema.fields}
        schema = T.StructType([T.StructField(k, types[k]) for k in keys] + FITTED)
        coefs = design.select(*keys, "_x", "_ys").groupBy(*keys).applyInPandas(_series_solver(keys, spec), schema)
    else:
        rows = cut_lineage(design.select("_x", "_ys"))  # read once for every linearisation
        spark = history.sparkSession
        fitted = []
        if not rows.isEmpty():
            grouped = rows.rdd.getNumPartitions() > MOMENT_GROUPS
            coef, sd, noise, n = fit_moments(lambda c: summed_moments(rows, spec, c, grouped), spec)
            fitted = [(coef.tolist(), sd, noise, int(n))]
        coefs = spark.createDataFrame(fitted, T.StructType(FITTED))
    full = attach_scalars(params, coefs, keys)
    # a fitted model is an artefact: one row per series, materialised like any estimator fit
    return ForecastModel(spec, keys, cut_lineage(full), ds)


def _dot(x: Column, coef: Column) -> Column:
    return F.aggregate(F.zip_with(x, coef, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def trend_variance(t: Column, changes: Column, n_changepoints: int) -> Column:
    """variance of the trend at scaled time ``t`` by changes after the history (t > 1).

    Changes come at the history's rate, ``n_changepoints`` in a unit of t, each Laplace with the
    history's mean size λ: the sum over a Poisson process of ``2λ² (t − c)²``, that is
    ``n · 2λ² · (t − 1)³ / 3``.
    """
    if not n_changepoints:
        return F.lit(0.0)
    size = F.aggregate(changes, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.lit(float(n_changepoints))
    ahead = F.greatest(t - F.lit(1.0), F.lit(0.0))
    return F.lit(float(n_changepoints)) * F.lit(2.0) * size * size * ahead * ahead * ahead / F.lit(3.0)


def predict_forecast(model: ForecastModel, future: DataFrame) -> DataFrame:
    """``(keys…, ds, yhat, yhat_lower, yhat_upper)`` for the rows of ``future``.

    ``future`` carries the keys, the date and the regressor columns.  The fitted
    parameters are one row per series; they are joined on the keys (broadcast
    when AQE measures them small) and scoring is a native dot product.  The band is
    ``yhat ± z·sd`` at the interval's normal quantile z, with the variance of the residuals and
    :func:`trend_variance` (times the squared factor ``1 + rest`` in multiplicative mode).
    """
    spec, ds, keys = model.spec, model.ds, model.keys
    scored = _design(future, model.params, keys, spec, ds)
    scale = F.coalesce(F.when(F.col("_yscale") > 0, F.col("_yscale")), F.lit(1.0))
    z = NormalDist().inv_cdf((1.0 + spec.interval_width) / 2.0)
    k, p = 2 + spec.n_changepoints, len(_prior_scales(spec))
    variance = trend_variance(F.get("_x", F.lit(1)), F.slice("coef", 3, spec.n_changepoints), spec.n_changepoints)
    noise = F.col("resid_sd") * F.col("resid_sd")
    if spec.mode == "multiplicative":
        factor = F.lit(1.0) + _dot(F.slice("_x", k + 1, p), F.slice("coef", k + 1, p))
        mid = _dot(F.slice("_x", 1, k), F.slice("coef", 1, k)) * factor
        variance = variance * factor * factor
    else:
        mid = _dot(F.col("_x"), F.col("coef"))
    passthrough = [c for c in future.columns if c not in keys and c != ds]
    staged = scored.withColumns({"_mid": mid * scale, "_half": F.lit(z) * F.sqrt(noise + variance) * scale})
    return staged.select(*keys, ds, *passthrough, F.col("_mid").alias("yhat"), (F.col("_mid") - F.col("_half")).alias("yhat_lower"),
                         (F.col("_mid") + F.col("_half")).alias("yhat_upper"))


# --- F1 / F8 / F9 / A4 ------------------------------------------------------------------------------

def regressor_frame(df: DataFrame, target: str, regressors: tuple[str, ...], keys: list[str] | None = None,
                    date_col: str = "date") -> DataFrame:
    """``(keys…, ds, y, regressors…)``."""
    keys = keys or []
    return df.select(*keys, F.col(date_col).alias("ds"), F.col(target).alias("y"), *regressors)


def combine_inputs(calls_fc: DataFrame, sick_fc: DataFrame, keys: list[str] | None = None,
                   n_duty: int | DataFrame = 1900, integer_inputs: bool = True, with_week: bool = False) -> DataFrame:
    """The model-input table ``date, calls, n_sick, year, n_duty``.

    The two forecasts are aligned by an equi-join on ``(keys, ds)`` (the
    reference aligns by position).  ``integer_inputs`` truncates the forecasts
    as production does; the evaluation track keeps them as doubles and adds
    the ISO week.  ``n_duty`` is one number for all series, or a table with a row
    per series.
    """
    keys = keys or []
    a = calls_fc.select(*keys, "ds", F.col("yhat").alias("calls"))
    b = sick_fc.select(*keys, "ds", F.col("yhat").alias("n_sick"))
    out = join_on_keys(a, b, keys + ["ds"]).withColumnRenamed("ds", "date")
    cols = {"year": F.year("date").cast("int")}
    if isinstance(n_duty, DataFrame):
        out = attach_scalars(out, n_duty, keys)
    else:
        cols["n_duty"] = F.lit(n_duty).cast("int")
    if integer_inputs:
        cols.update({"calls": F.col("calls").cast("int"), "n_sick": F.col("n_sick").cast("int")})
    if with_week:
        cols["week"] = F.weekofyear("date").cast("int")
    out = out.withColumns(cols)
    # column order of the reference's two input tables (evaluation / production)
    order = ["date", "calls", "year", "week", "n_duty", "n_sick"] if with_week else \
        ["date", "calls", "n_sick", "year", "n_duty"]
    return out.select(*keys, *order)


def forecast_metrics(actual: DataFrame, forecast: DataFrame, keys: list[str] | None = None,
                     y: str = "y", ds: str = "ds") -> DataFrame:
    """MSE, RMSE, MAE and mean ratio actual/forecast per series (joined on date)."""
    keys = keys or []
    j = join_on_keys(actual.select(*keys, ds, F.col(y).cast("double").alias("_y")),
                     forecast.select(*keys, ds, "yhat"), keys + [ds], "inner")
    e = F.col("_y") - F.col("yhat")
    g = j.groupBy(*keys) if keys else j.groupBy()
    return (g.agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                  F.avg(F.try_divide(F.col("_y"), F.col("yhat"))).alias("mean_ratio"))
            .withColumn("rmse", F.sqrt("mse")))
