"""Boosted trees of four kinds, and searches over them with staged rounds.

The learners of the reference differ in how a tree grows and in how its leaves are
weighed; one histogram learner holds them all:

* ``level``: every leaf of a level is split at its best place; with ``l2`` and ``gamma`` these are
  regularised Newton trees (leaf ``G / (H + λ)``, gain ``½[GL²/(HL+λ) + GR²/(HR+λ) − G²/(H+λ)] − γ``);
* ``leaf``: best first, the leaf with the largest gain is split next until there are ``leaves``; the
  histogram of the larger child is the parent's less the smaller child's;
* ``oblivious``: one split for all leaves of a level, the one with the largest sum of gains; with
  ``ordered`` the residual of a row is taken from leaf values of the rows before it in a
  fixed permutation.

Bins are cut at quantiles that Spark sketches (``percentile_approx``).  One fit is one group
of ``applyInPandas``: a series' daily history, whose length the calendar bounds, or a whole
frame of at most ``MAX_ROWS`` rows (more raise; for those there are the Spark ML learners of
``operators.learn``).  A search is many such fits at once, one group each: Spark deals
candidates × folds over the cluster.  A fit is scored after every number of rounds
asked for, as boosting with fewer rounds is a prefix of it, so a grid of rounds costs one fit.

Rows with a null feature or label take no part in a fit and get no prediction.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostercast.functions.scalars import attach_scalars
from rostercast.operators.evaluate import fold_ids, split_hash
from rostercast.session import cut_lineage

MAX_ROWS = 200_000
TARGET = "sby_need"


@dataclass(frozen=True)
class Boosting:
    growth: str = "level"
    rounds: int = 100
    rate: float = 0.1
    depth: int = 3        # level, oblivious
    leaves: int = 31      # leaf
    l2: float = 0.0
    gamma: float = 0.0
    min_rows: int = 1
    ordered: bool = False
    bins: int = 256


# Documented defaults of the four libraries, and the reference's grids (rounds, rate, depth or leaves).
PROFILES = {
    "Gradient Boosting Regressor": Boosting("level", 100, 0.1, depth=3),
    "XGBoost Regressor": Boosting("level", 100, 0.3, depth=6, l2=1.0),
    "LightGBM Regressor": Boosting("leaf", 100, 0.1, leaves=31, min_rows=20),
    "CatBoost Regressor": Boosting("oblivious", 1000, 0.03, depth=6, l2=3.0, ordered=True),
}
GRIDS = {
    "Gradient Boosting Regressor": {"rounds": [50, 100, 200], "rate": [0.01, 0.05, 0.1], "depth": [3, 4, 5]},
    "XGBoost Regressor": {"rounds": [50, 100, 200], "rate": [0.01, 0.05, 0.1], "depth": [3, 4, 5]},
    "LightGBM Regressor": {"rounds": [50, 100, 200], "rate": [0.01, 0.05, 0.1], "leaves": [31, 50, 100]},
    "CatBoost Regressor": {"rounds": [100, 200, 300], "rate": [0.01, 0.05, 0.1], "depth": [3, 4, 5]},
}


# --- one tree on binned rows ---------------------------------------------------------------------------

@dataclass
class Tree:
    feature: list = field(default_factory=list)   # -1: leaf
    threshold: list = field(default_factory=list)  # bin while growing, value afterwards
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def node(self) -> int:
        for column, empty in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def split(self, at: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[at], self.threshold[at], self.left[at], self.right[at] = feature, bin_, self.node(), self.node()
        return self.left[at], self.right[at]


class Rows:
    """Binned rows; histograms of any groups of rows, the bins of all features side by side."""

    def __init__(self, bins: np.ndarray, widths: list[int]):
        self.bins, self.features, self.size = bins, len(widths), int(sum(widths))
        self.starts = np.cumsum([0, *widths[:-1]])
        self.feature_of = np.repeat(np.arange(len(widths)), widths)
        self.last = np.zeros(self.size, bool)
        self.last[np.cumsum(widths) - 1] = True  # nothing lies right of a feature's last bin
        self.codes = bins + self.starts

    def histograms(self, rows: np.ndarray, group: np.ndarray, groups: int, residual: np.ndarray) -> np.ndarray:
        """Sums of residuals and counts, ``(2, groups, bins of all features)``."""
        codes = (self.codes[rows] + (group * self.size)[:, None]).ravel()
        shape = (groups, self.size)
        return np.stack([np.bincount(codes, np.repeat(residual[rows], self.features), groups * self.size).reshape(shape),
                         np.bincount(codes, minlength=groups * self.size).astype(float).reshape(shape)])

    def place(self, code: int) -> tuple[int, int]:
        f = int(self.feature_of[code])
        return f, int(code - self.starts[f])

    def gains(self, hist: np.ndarray, spec: Boosting) -> np.ndarray:
        """Gain of the split after every bin ``(groups, bins)``; minus infinity where a side has too few rows."""
        running = np.cumsum(hist, axis=2)
        before = np.concatenate([np.zeros((2, hist.shape[1], 1)), running], axis=2)[:, :, self.starts]
        (gl, hl) = running - before[:, :, self.feature_of]
        g, h = hist[:, :, self.feature_of == 0].sum(axis=2, keepdims=True)
        gr, hr = g - gl, h - hl
        side = lambda s, n: np.where(n > 0, s * s / np.maximum(n + spec.l2, 1e-300), 0.0)
        out = 0.5 * (side(gl, hl) + side(gr, hr) - side(g, h)) - spec.gamma
        return np.where((hl >= spec.min_rows) & (hr >= spec.min_rows) & ~self.last, out, -np.inf)


def weight(g, h, spec: Boosting):
    return np.where(h > 0, spec.rate * g / np.maximum(h + spec.l2, 1e-300), 0.0)


def grow_level(rows: Rows, residual: np.ndarray, spec: Boosting) -> tuple[Tree, np.ndarray]:
    """A tree and the leaf of every row."""
    tree, n = Tree(), len(residual)
    leaf = np.full(n, tree.node())
    live = [0]
    for _ in range(spec.depth):
        slot = np.full(len(tree.feature), -1)
        slot[live] = np.arange(len(live))
        here = np.flatnonzero(slot[leaf] >= 0)
        best = rows.gains(rows.histograms(here, slot[leaf[here]], len(live), residual), spec)
        choice = best.argmax(axis=1)
        new = []
        for i, at in enumerate(live):
            if best[i, choice[i]] > 1e-12:
                new += tree.split(at, *rows.place(choice[i]))
        if not new:
            break
        leaf = descend(tree, rows.bins, leaf)
        live = new
    set_values(tree, leaf, residual, spec)
    return tree, leaf


def grow_leaf(rows: Rows, residual: np.ndarray, spec: Boosting) -> tuple[Tree, np.ndarray]:
    tree, leaf = Tree(), np.zeros(len(residual), int)
    tree.node()
    queue: list = []

    def offer(at: int, members: np.ndarray, hist: np.ndarray) -> None:
        best = rows.gains(hist, spec)[0]
        c = int(best.argmax())
        if best[c] > 1e-12:
            heapq.heappush(queue, (-best[c], at, *rows.place(c), members, hist))

    def hist_of(members: np.ndarray) -> np.ndarray:
        return rows.histograms(members, np.zeros(len(members), int), 1, residual)

    everyone = np.arange(len(residual))
    offer(0, everyone, hist_of(everyone))
    count = 1
    while queue and count < spec.leaves:
        _, at, f, b, members, hist = heapq.heappop(queue)
        left, right = tree.split(at, f, b)
        goes = rows.bins[members, f] <= b
        sides = [members[goes], members[~goes]]
        leaf[sides[0]], leaf[sides[1]] = left, right
        small = int(len(sides[1]) < len(sides[0]))
        first = hist_of(sides[small])
        for side, node in ((small, (left, right)[small]), (1 - small, (left, right)[1 - small])):
            offer(node, sides[side], first if side == small else hist - first)
        count += 1
    set_values(tree, leaf, residual, spec)
    return tree, leaf


def grow_oblivious(rows: Rows, residual: np.ndarray, spec: Boosting) -> tuple[Tree, np.ndarray]:
    tree = Tree()
    live, leaf = [tree.node()], np.zeros(len(residual), int)
    every = np.arange(len(residual))
    for _ in range(spec.depth):
        slot = np.full(len(tree.feature), -1)
        slot[live] = np.arange(len(live))
        total = rows.gains(rows.histograms(every, slot[leaf], len(live), residual), replace(spec, min_rows=0)).sum(axis=0)
        c = int(total.argmax())
        if total[c] <= 1e-12:
            break
        f, b = rows.place(c)
        live = [child for at in live for child in tree.split(at, f, b)]
        leaf = descend(tree, rows.bins, leaf)
    set_values(tree, leaf, residual, spec)
    return tree, leaf


GROW = {"level": grow_level, "leaf": grow_leaf, "oblivious": grow_oblivious}


def descend(tree: Tree, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf that every row reaches from its node ``at``; goes left where the value is at most the threshold."""
    feature, threshold = np.asarray(tree.feature), np.asarray(tree.threshold, float)
    left, right = np.asarray(tree.left), np.asarray(tree.right)
    rows = np.arange(len(at))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        goes = values[rows, np.maximum(f, 0)] <= threshold[at]
        at = np.where(inner, np.where(goes, left[at], right[at]), at)


def set_values(tree: Tree, leaf: np.ndarray, residual: np.ndarray, spec: Boosting) -> None:
    n = len(tree.feature)
    values = weight(np.bincount(leaf, residual, n), np.bincount(leaf, minlength=n).astype(float), spec)
    tree.value = np.where(np.asarray(tree.feature) < 0, values, 0.0).tolist()


def earlier_values(leaf: np.ndarray, residual: np.ndarray, spec: Boosting) -> np.ndarray:
    """Leaf values from the rows of the same leaf that come before each row."""
    order = np.argsort(leaf, kind="stable")
    sums, first = np.cumsum(residual[order]) - residual[order], np.searchsorted(leaf[order], leaf[order])
    out = np.empty(len(leaf))
    out[order] = weight(sums - sums[first], (np.arange(len(leaf)) - first).astype(float), spec)
    return out


@dataclass
class Ensemble:
    base: float
    trees: list[Tree]

    def staged(self, X: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions after 1, 2, … rounds."""
        total = np.full(len(X), self.base)
        for t in self.trees:
            total = total + np.asarray(t.value)[descend(t, X, np.zeros(len(X), int))]
            yield total

    def predict(self, X: np.ndarray) -> np.ndarray:
        total = np.full(len(X), self.base)
        for total in self.staged(X):
            pass
        return total


def boosted(X: np.ndarray, y: np.ndarray, edges: list[np.ndarray], spec: Boosting) -> Ensemble:
    """Squared-error boosting from the mean; rows stand in the order of the fixed permutation."""
    bins = np.column_stack([np.searchsorted(e, X[:, j], side="left") for j, e in enumerate(edges)])
    rows, base = Rows(bins, [len(e) + 1 for e in edges]), float(y.mean()) if len(y) else 0.0
    present, trees = np.full(len(y), base), []
    for _ in range(spec.rounds if len(y) else 0):
        residual = y - present
        tree, leaf = GROW[spec.growth](rows, residual, spec)
        present = present + (earlier_values(leaf, residual, spec) if spec.ordered else np.asarray(tree.value)[leaf])
        tree.threshold = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold, strict=True)]
        trees.append(tree)
    return Ensemble(base, trees)


# --- in Spark ----------------------------------------------------------------------------------------------

def bin_edges(df: DataFrame, features: list[str], bins: int = 256, keys: list[str] | None = None) -> DataFrame:
    """``(keys…, _edges)``: an array of at most ``bins - 1`` cut points for each feature, from a quantile sketch."""
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(f"`{f}`").cast("double"), probs, 10_000))) for f in features]
    return df.groupBy(*(keys or [])).agg(F.array(*cuts).alias("_edges"))


def prepared(df: DataFrame, features: list[str], label: str | None, order: list[str]) -> DataFrame:
    """``_x``, ``_y`` and the permutation ``_h`` beside the columns of ``df``; rows with nulls among them are left out."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    out = df.withColumns({"_x": x, "_y": F.col(f"`{label}`").cast("double") if label else F.lit(0.0), "_h": split_hash(order)})
    return out.where(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))


MODEL = "base double, trees string"


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.zeros((0, 1))


def _packed(e: Ensemble) -> str:
    return json.dumps([asdict(t) for t in e.trees])


def _unpacked(base: float, trees: str) -> Ensemble:
    return Ensemble(base, [Tree(**t) for t in json.loads(trees)])


def _bounded(df: DataFrame, keys: list[str]) -> None:
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else df.count()
    if (most or 0) > MAX_ROWS:
        raise ValueError(f"{most} rows for one fit, at most {MAX_ROWS}; use the learners of operators.learn")


def fit_boosting(train: DataFrame, features: list[str], spec: Boosting, label: str = TARGET, keys: list[str] | None = None,
                 order: list[str] | None = None) -> DataFrame:
    """``(keys…, base, trees)``: a model for every series, fitted side by side; without keys one model."""
    keys = list(keys or [])
    rows = cut_lineage(prepared(train, features, label, order or ["date"]).select(*keys, "_x", "_y", "_h"))
    _bounded(rows, keys)
    edges = bin_edges(train, features, spec.bins, keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_y"], kind="stable")
        e = boosted(_matrix(pdf), pdf["_y"].to_numpy(float), [np.asarray(c, float) for c in pdf["_edges"].iloc[0]], spec)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "base": [e.base], "trees": [_packed(e)]})

    kept = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField(k, kept[k]) for k in keys] + T.StructType.fromDDL(MODEL).fields)
    return cut_lineage(attach_scalars(rows, edges, keys).groupBy(*keys).applyInPandas(fit, schema))


def score_boosting(model: DataFrame, df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``prediction``; a model is one row (bounded by rounds × leaves), joined by key."""
    keys = list(keys or [])
    schema = T.StructType(df.schema.fields + [T.StructField("prediction", T.DoubleType())])
    names = [f"`{c}`" for c in df.columns]

    def scored(pdf: pd.DataFrame, base: float, trees: str) -> pd.DataFrame:
        X = pdf[list(features)].to_numpy(float)
        full = ~np.isnan(X).any(axis=1)
        out = np.full(len(X), np.nan)
        out[full] = _unpacked(base, trees).predict(X[full])
        return pdf.assign(prediction=pd.Series(out, index=pdf.index).where(full, None))

    if keys:
        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(right) or not len(left):
                return left.assign(prediction=None)
            return scored(left, right["base"].iloc[0], right["trees"].iloc[0])
        return df.select(*names).groupBy(*keys).cogroup(model.groupBy(*keys)).applyInPandas(pair, schema)
    one = model.first()

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield scored(pdf, one["base"], one["trees"]) if one else pdf.assign(prediction=None)
    return df.select(*names).mapInPandas(every, schema)


# --- many fits at once -----------------------------------------------------------------------------------

ERRORS = "task string, fold int, rounds int, n long, mae double, mse double, rmse double, r2 double"


def _measures(y: np.ndarray, p: np.ndarray) -> tuple:
    e, v = y - p, float(y.var()) if len(y) else 0.0
    mse = float((e * e).mean()) if len(y) else None
    r2 = None if mse is None else 1 - mse / v if v > 0 else float(mse == 0)
    return len(y), float(np.abs(e).mean()) if len(y) else None, mse, None if mse is None else mse ** 0.5, r2


def fit_errors(train: DataFrame, features: list[str], shapes: list[tuple[Boosting, list[str], list[int]]], k: int = 5, test: DataFrame | None = None,
               label: str = TARGET, order: list[str] | None = None, ledger: str | None = None, batch: int = 400, batches: int | None = None) -> DataFrame:
    """Errors of every shape ``(learner, its features, numbers of rounds)`` on each of ``k`` contiguous folds, and on ``test`` (fold -1).

    A task, one shape and fold, is one group; it is scored after each number of rounds.  With
    ``ledger``, a path, finished tasks are appended there ``batch`` at a time and a search that
    starts again does only those it does not find (``batches``: stop after so many).  Tasks are named by learner,
    features, fold and a fingerprint of the rows, so other data never count as done.
    """
    spark = train.sparkSession
    order = order or ["date"]
    rows = prepared(fold_ids(cut_lineage(train), k, out_col="_fold"), features, label, order).select("_x", "_y", "_h", "_fold")
    if test is not None:
        rows = rows.unionByName(prepared(test, features, label, order).select("_x", "_y", "_h", F.lit(-1).alias("_fold")))
    rows = cut_lineage(rows)
    _bounded(rows, [])
    mark = rows.agg(F.bit_xor(F.xxhash64("_x", "_y", "_fold", "_h"))).first()[0]
    edges = {}
    place = {f: i for i, f in enumerate(features)}
    known = {}
    for spec, own, staged in shapes:
        if spec.bins not in edges:
            cuts = bin_edges(train, features, spec.bins).first()["_edges"]
            edges[spec.bins] = [np.asarray(c if c is not None else [], float) for c in cuts]
        top = replace(spec, rounds=max(staged))
        for fold in [*range(k), *([-1] if test is not None else [])]:
            name = json.dumps([asdict(top), own, fold, label, mark])
            have = known.setdefault(name, (top, [place[f] for f in own], fold, set()))
            have[3].update(staged)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["_task"].iloc[0]
        spec, columns, fold, staged = known[name]
        pdf = pdf.sort_values(["_h", "_y"], kind="stable")
        X, y, f = _matrix(pdf)[:, columns], pdf["_y"].to_numpy(float), pdf["_fold"].to_numpy()
        learn, judge = (f >= 0) & (f != fold), f == fold
        e = boosted(X[learn], y[learn], [edges[spec.bins][c] for c in columns], spec)
        return pd.DataFrame([(name, fold, i + 1, *_measures(y[judge], p)) for i, p in enumerate(e.staged(X[judge])) if i + 1 in staged],
                            columns=[c.split()[0] for c in ERRORS.split(", ")])

    def results(names: list[str]) -> DataFrame:
        # a stated list of tasks against the bounded rows
        each = rows.withColumn("_task", F.explode(F.array(*[F.lit(n) for n in names])))
        return each.repartition(min(len(names), 2 * spark.sparkContext.defaultParallelism), "_task").groupBy("_task").applyInPandas(run, ERRORS)

    names = list(known)
    if ledger is None:
        return cut_lineage(results(names))
    empty = spark.createDataFrame([], ERRORS)
    empty.write.mode("append").parquet(ledger)
    wanted = spark.createDataFrame([(n,) for n in names], "task string")
    todo = [r["task"] for r in wanted.join(spark.read.schema(empty.schema).parquet(ledger), "task", "left_anti").collect()]
    for i, at in enumerate(range(0, len(todo), batch)):
        if batches is not None and i >= batches:
            break
        results(todo[at:at + batch]).write.mode("append").parquet(ledger)
    return spark.read.schema(empty.schema).parquet(ledger).join(wanted, "task", "left_semi")


def points(model: str, defaults: Boosting | None = None) -> list[Boosting]:
    """The reference's grid of a model."""
    grid = GRIDS[model]
    return [replace(defaults or PROFILES[model], **dict(zip(grid, values, strict=True))) for values in product(*grid.values())]


def _shapes(specs: list[Boosting], own: list[str]) -> list[tuple[Boosting, list[str], list[int]]]:
    """Points that differ in rounds alone are one shape."""
    together: dict[Boosting, list[int]] = {}
    for s in specs:
        together.setdefault(replace(s, rounds=0), []).append(s.rounds)
    return [(replace(s, rounds=max(r)), own, sorted(set(r))) for s, r in together.items()]


def _point_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "model string, n_features int, variant string, point int, params string, shape string, rounds int")


def boosting_search(spark: SparkSession, train: DataFrame, test: DataFrame | None, ranked: list[str], models: list[str] | None = None,
                    counts: list[int] | None = None, k: int = 5, label: str = TARGET, tune: bool = True, ledger: str | None = None) -> DataFrame:
    """Every model × count of the best features × {default, each grid point}, selected by cross-validation.

    Returns ``(model, n_features, variant, point, params, rounds, cv_mse, mae, mse, rmse, r2, is_best)``, a row for
    every candidate; the measures are those on ``test`` of the fit on all training rows.  The best of a
    model has the least ``cv_mse``, ties to fewer features, then the default, then the earlier point.
    """
    shapes, rows = [], []
    for model in models or list(PROFILES):
        for n in counts or range(1, len(ranked) + 1):
            specs = [("default", -1, PROFILES[model]), *([("tuned", i, p) for i, p in enumerate(points(model))] if tune else [])]
            for s in _shapes([p for _, _, p in specs], ranked[:n]):
                shapes.append(s)
            tops = {replace(s, rounds=0): s.rounds for s, own, _ in shapes if own == ranked[:n]}
            for variant, i, p in specs:
                top = replace(p, rounds=tops[replace(p, rounds=0)])
                shown = json.dumps({a: getattr(p, a) for a in GRIDS[model]})
                rows.append((model, n, variant, i, shown, json.dumps([asdict(top), ranked[:n]]), p.rounds))
    errors = fit_errors(train, ranked, shapes, k, test, label, ledger=ledger)
    shape = F.get_json_object("task", "$[0]")
    keyed = errors.withColumn("shape", F.concat(F.lit("["), shape, F.lit(","), F.get_json_object("task", "$[1]"), F.lit("]")))
    cv = keyed.where("fold >= 0").groupBy("shape", "rounds").agg(F.avg("mse").alias("cv_mse"))
    measured = keyed.where("fold < 0").select("shape", "rounds", "mae", "mse", "rmse", "r2")
    frame = _point_frame(spark, rows).withColumn("shape", F.concat(F.lit("["), F.get_json_object("shape", "$[0]"), F.lit(","), F.get_json_object("shape", "$[1]"), F.lit("]")))
    out = frame.join(cv, ["shape", "rounds"], "left").join(measured, ["shape", "rounds"], "left")
    w = Window.partitionBy("model").orderBy(F.col("cv_mse").asc_nulls_last(), "n_features", "point")
    return out.withColumn("is_best", F.row_number().over(w) == 1).select(
        "model", "n_features", "variant", "point", "params", "rounds", "cv_mse", "mae", "mse", "rmse", "r2", "is_best")
