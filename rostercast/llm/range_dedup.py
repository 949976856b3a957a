"""Embedding near-duplicates by an exact metric range join.

Cosine at least ``COSINE`` means that unit vectors are at most
``EPS = sqrt(2 - 2 * COSINE)`` apart.  Pivots partition the unit vectors: each lies
in the cell of its nearest pivot h.  A vector that is linked to x but lies in p's
cell is nearer to p than to h, so by the triangle inequality x must satisfy
``d(x, p) <= d(x, h) + 2 EPS``, and in Euclidean space even
``(d(x, p)^2 - d(x, h)^2) / (2 d(p, h)) <= EPS``: x is replicated to exactly those
cells.  Every cell then joins alone: its own vectors against all that it holds.
Pivots that do not keep cells apart only multiply rows, so more are used only
where the shares of a sample that the cells hold promise a clearly lower cost.

Cells are cut into blocks of about ``BLOCK`` rows and joined block by block, so a
cell with any share of the rows is many tasks of bounded size.  A task counts the
links of its own vectors, and hands on a spanning forest of the links it saw
instead of the links themselves.  Equal vectors are one node with a number of
copies.  Single precision decides what is far from the threshold; the rest is
computed in double precision.

Vectors that are null, zero or hold null or non-finite components link with
nothing; so do rows without an id; vectors of different lengths are never linked;
repeated rows count as copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import connected_components, row_sample, staged, table
from rostercast.llm.vectors import matrix, valid_vectors

COSINE = 0.95
BLOCK = 8192
MAX_PIVOTS = 1024  # the pivots' own bound; cells that stay large have more blocks
STRIPE = 512  # rows of a block that are compared at a time
SLACK = 1e-9
SAMPLE = 4096  # vectors that the pivots are taken from and measured on, on average
COMPARED = 1000  # comparisons that cost as much as a row that is shuffled
WORTH = 0.8  # more pivots must bring the cost under this part of that of fewer
STAGED = 4  # shuffled rows that cost as much as a row of the cells' table, which is written once and read three times


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spread_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """``k`` far-apart rows of the sample: each next one is the farthest from those taken."""
    taken = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < k and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def cells_of(u: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and for each vector and pivot whether its cell needs the vector."""
    c = u @ pivots.T
    home = c.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    own = c[np.arange(len(u)), home][:, None]
    needs = (own - c) <= (eps + SLACK) * between + SLACK
    return home, needs


def pivot_count(sample: np.ndarray, pivots: np.ndarray, eps: float, rows: int) -> int:
    """How many of ``pivots`` (1, 2, 4, … or all) are worth their rows for ``rows`` vectors that lie as the sample does.

    A cell with a share h of the vectors at home that holds a share a of them stages a of the rows, sends h of them to every
    block of a and a of them to every block of h, and compares h with a.
    """
    best, least = 1, math.inf
    for k in sorted({min(1 << i, len(pivots)) for i in range(len(pivots).bit_length() + 1)}):
        home, needs = cells_of(sample, pivots[:k], eps)
        h, a = rows * np.bincount(home, minlength=k) / len(sample), rows * needs.mean(axis=0)
        cost = (STAGED * a + h * np.ceil(a / BLOCK) + a * np.ceil(h / BLOCK) + h * a / COMPARED).sum()
        if cost < WORTH * least:
            best, least = k, cost
    return best


class Forest:
    """Union-find over local numbers, for arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.up[a], self.up[b]
            open_ = a != b
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (jump := self.up[self.up]).tobytes() != self.up.tobytes():
                self.up = jump


def block_links(home: pa.Table, others: pa.Table, cosine: float) -> pa.Table:
    """Per vector of ``home`` its links (weighted by copies), and a forest of them: ``(a, b, n)``."""
    ids, other = home["id"].to_numpy(), others["id"].to_numpy()
    x, y, w = matrix(home["v"]), matrix(others["v"]), others["copies"].to_numpy().astype(np.float64)
    ux, uy = unit(x), unit(y)
    sx, sy = ux.astype(np.float32), uy.astype(np.float32).T.copy()
    margin = max(1e-5, 4e-7 * x.shape[1])
    every = np.unique(np.concatenate([ids, other]))
    at_home, at_other = np.searchsorted(every, ids), np.searchsorted(every, other)
    forest, count = Forest(len(every)), np.zeros(len(ids))
    for a in range(0, len(ids), STRIPE):
        s = sx[a : a + STRIPE] @ sy
        i, j = np.nonzero(s >= cosine - margin)
        if not len(i):
            continue
        good = s[i, j] >= cosine + margin
        near = np.flatnonzero(~good)
        for p in range(0, len(near), 1 << 16):  # in double precision, a bounded number at a time
            q = near[p : p + (1 << 16)]
            v, z = x[a + i[q]], y[j[q]]
            good[q] = (v * z).sum(axis=1) / (np.sqrt((v * v).sum(axis=1)) * np.sqrt((z * z).sum(axis=1))) >= cosine
        good &= at_home[a + i] != at_other[j]
        i, j = i[good], j[good]
        count += np.bincount(a + i, weights=w[j], minlength=len(ids))
        forest.join(at_home[a + i], at_other[j])
    linked, child = np.flatnonzero(count), np.flatnonzero(forest.up != np.arange(len(every)))
    return pa.table({
        "a": np.concatenate([ids[linked], every[child]]),
        "b": pa.array(np.concatenate([ids[linked], every[forest.up[child]]])),
        "n": np.concatenate([count[linked], np.zeros(len(child))]).astype(np.int64)})


def range_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(a, b, n)`` from ``(id, copies, v)``: ``n`` links of ``a`` where a = b, else an edge of the forest."""
    eps = math.sqrt(2 - 2 * cosine)
    rows = nodes.count()
    most = min(MAX_PIVOTS, max(1, rows // BLOCK))
    sample: dict[int, list[bytes]] = {}
    for v in sorted(bytes(r.v) for r in row_sample(nodes.select("id", "v"), SAMPLE).collect()):  # about that many
        sample.setdefault(len(v), []).append(v)
    drawn = sum(map(len, sample.values()))
    pivots = {}
    for n, v in sample.items():
        u = unit(np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1))
        taken = spread_pivots(u, most)
        pivots[n] = taken[: pivot_count(u, taken, eps, rows * len(v) // drawn)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(v.as_py()) for v in batch.column(2)])
            for n in np.unique(size).tolist():
                own = batch.filter(pa.array(size == n))
                if n in pivots:
                    home, needs = cells_of(unit(matrix(own.column(2))), pivots[n], eps)
                else:  # a length that the sample has not seen: one cell
                    home, needs = np.zeros(own.num_rows, np.int64), np.ones((own.num_rows, 1), bool)
                row, cell = np.nonzero(needs)
                got = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*got.columns, pa.array(n * 4096 + cell, pa.int64()), pa.array(home[row] == cell)], ["id", "copies", "v", "cell", "home"])

    held = staged(nodes.select("id", "copies", "v").mapInArrow(placed, "id long, copies long, v binary, cell long, home boolean"), "cells")
    # one row for each pivot
    sizes = held.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("all"))
    held = held.join(F.broadcast(sizes), "cell").withColumn("at", F.xxhash64("id", "v"))
    # blocks by hash; each of a cell's home blocks meets each block of all its rows
    home = held.where("home").withColumn("i", F.expr("cast(pmod(at, homes) as int)")).withColumn("j", F.explode(F.expr("sequence(0, `all` - 1)")))
    every = held.where("homes > 0").withColumn("j", F.expr("cast(pmod(at, `all`) as int)")).withColumn("i", F.explode(F.expr("sequence(0, homes - 1)")))
    keys = ["cell", "i", "j"]

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return block_links(left, right, cosine)

    return staged(home.select(*keys, "id", "v").groupBy(*keys)
                  .cogroup(every.select(*[F.col(c).alias(c) for c in (*keys, "id", "v", "copies")]).groupBy(*keys))
                  .applyInArrow(joined, "a long, b long, n long"), "links")


def range_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row."""
    valid = valid_vectors(rows, key, vector)
    groups = staged(valid.groupBy("h").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "groups")
    nodes = staged(valid.join(groups, "h").where("id = node").dropDuplicates(["h"]).select("id", "copies", "v"), "nodes")
    links = range_links(nodes, cosine)
    count = links.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    root = connected_components(links.where("a <> b"), "a", "b")
    # one row for each id: its node may have links; ids that come twice are nodes of both
    member = (valid.select("id", "h").join(groups, "h").join(count, "node", "left").join(root, "node", "left")
              .groupBy("id").agg(F.max(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                 F.min(F.coalesce("root", "node")).alias("component")))
    own = F.col(key).cast("long")
    return (rows.select(F.col(key)).join(member, own == F.col("id"), "left")
            .select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", own).alias("component_id"))
            .withColumn("kept", own.eqNullSafe(F.col("component_id"))))


def op9_range_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id,
       v.vec_id <= coalesce(c.c, v.vec_id) AS kept
FROM embeddings v
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = v.vec_id
"""
