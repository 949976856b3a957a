"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

A k-means tree is fitted on a hashed sample of at most about ``SAMPLE`` rows: nodes
split into ``BRANCH`` children until a leaf stands for about ``LEAF`` rows of the
whole table.  Every row then descends to one leaf.  A query walks the tree with a
priority queue of unopened branches ordered by the distance to their centres, so
leaves come up best bin first.

How many leaves it opens is calibrated: for ``TRIALS`` of the queries the true
neighbours are found by brute force over all rows, and leaf visits are widened
until ``RECALL`` of those neighbours lie in the leaves visited.  A query that has
met too few rows for its neighbours goes on regardless.

Rows and queries meet by leaf and block: leaves with many rows are cut into blocks
of about ``BLOCK`` rows, the queries that visit a leaf into groups of about ``GROUP``,
and every block meets every group.  Each block gives a query its best ``k``, and the
best ``k`` of those stay.  Distances are worked out for ``STRIPE`` queries at a time,
so that no task's memory grows with the queries.  Distances are Euclidean, in double precision on the original vectors.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do rows without an id or vectors of another length than most; a query's own
id is no candidate; ties go to the smaller id; fewer candidates than ``k`` all come
out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostercast.llm.common import row_sample, staged, table
from rostercast.llm.vectors import matrix, valid_vectors

SAMPLE = 20_000
BRANCH, LEAF, LEAST = 8, 1024, 8  # children of a node, rows of a leaf, sample rows that a split needs
ROUNDS = 8
TRIALS, RECALL = 200, 0.97
BLOCK, GROUP, STRIPE = 4096, 4096, 256
EVERY = 100  # ids divisible by this are queries
K = 10


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product: to rank and to prune, not to report."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0)


class Tree:
    """``centre`` of every node; ``children`` of inner nodes; ``leaf`` number of the others."""

    def __init__(self, sample: np.ndarray, rows_each: float, leaf_rows: int = LEAF, seed: int = 3):
        self.centre: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, rows_each, leaf_rows, rng)
        self.points = np.array(self.centre)

    def _grow(self, x: np.ndarray, rows_each: float, leaf_rows: int, rng: np.random.Generator) -> int:
        node = len(self.centre)
        self.centre.append(x.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        groups = self._split(x, rng) if len(x) * rows_each > leaf_rows and len(x) >= LEAST else []
        if len(groups) < 2:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self._grow(g, rows_each, leaf_rows, rng) for g in groups]
        return node

    @staticmethod
    def _split(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
        for _ in range(ROUNDS):
            near = distances(x, centres).argmin(axis=1)
            centres = np.stack([x[near == i].mean(axis=0) for i in np.unique(near)])
        near = distances(x, centres).argmin(axis=1)
        return [x[near == i] for i in np.unique(near)]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = distances(x[rows], self.points[self.children[node]]).argmin(axis=1)
            todo += [(c, rows[near == i]) for i, c in enumerate(self.children[node]) if (near == i).any()]
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        far = distances(q[None], self.points)[0].tolist()
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                first, *rest = sorted(self.children[node], key=far.__getitem__)
                for c in rest:
                    heapq.heappush(queue, (far[c], c))
                node = first
            yield self.leaf[node]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """``(query, id, score)`` of each query's ``k`` nearest among ``x``, ties to smaller ids."""
    out = []
    slack = 1e-9 * (1 + (q * q).sum(1) + (x * x).sum(1).max(initial=0))
    for i, qid in enumerate(q_ids.tolist()):
        if i % STRIPE == 0:
            approx = distances(q[i : i + STRIPE], x)
        d = np.where(ids == qid, np.inf, approx[i % STRIPE])
        n = min(k, int(np.isfinite(d).sum()))
        if not n:
            continue
        near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1] + slack[i])
        score = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], score))[:n]
        out += [(qid, int(ids[near[j]]), float(score[j])) for j in order]
    return out


def found_table(rows: list[tuple[int, int, float]]) -> pa.Table:
    q, v, s = zip(*rows) if rows else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, ranked; each block brings ``k`` rows of a query at most."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def brute_force(queries: list[tuple[int, bytes]], rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, vec_id, score)`` of a few queries against all ``(id, v)``, each batch on its own, then ranked."""
    q_ids = np.array([i for i, _ in queries], np.int64)
    q = np.frombuffer(b"".join(v for _, v in queries), np.float64).reshape(len(queries), -1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from found_table(best(q_ids, q, b.column(0).to_numpy(), matrix(b.column(1)), k) if b.num_rows else []).to_batches()

    return top(rows.select("id", "v").mapInArrow(scan, FOUND), k)


FOUND = "query_id long, vec_id long, score double"


def visits_needed(tree: Tree, trials: list[tuple[int, bytes]], placed: DataFrame, k: int) -> int:
    """Leaf visits that reach ``RECALL`` of the true neighbours of the trial queries."""
    true = brute_force(trials, placed, k).join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").select("query_id", "leaf").collect()
    at = {i: {leaf: n for n, leaf in enumerate(tree.walk(np.frombuffer(v, np.float64)))} for i, v in trials}
    ranks = np.sort([at[r.query_id][r.leaf] for r in true])
    return int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1 if len(ranks) else 1


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id ``every`` divides."""
    spark = rows.sparkSession
    valid = valid_vectors(rows, key, vector).select("id", "v").withColumn("size", F.octet_length("v"))
    usual = valid.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.col("size") == usual["size"])
    sample = sorted(bytes(r.v) for r in row_sample(valid.select("id", "v"), SAMPLE).collect())  # about SAMPLE rows
    x = np.frombuffer(b"".join(sample), np.float64).reshape(-1, usual["size"] // 8)
    tree = Tree(x if len(x) else np.zeros((1, usual["size"] // 8)), usual["count"] / max(len(x), 1))

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.leaf_of(matrix(b.column(1))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["id", "v", "leaf"])

    placed = staged(valid.select("id", "v").mapInArrow(descend, "id long, v binary, leaf long"), "leaves")
    filled = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # the tree's leaves at most
    queries = placed.where(F.col("id") % every == 0).select("id", "v").dropDuplicates(["id"])
    trials = [(r.id, bytes(r.v)) for r in row_sample(queries, TRIALS).orderBy("id").limit(2 * TRIALS).collect()]
    visits = visits_needed(tree, trials, placed, k) if trials else tree.leaves

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q in matrix(b.column(1)):
                met, leaves = 0, []
                for n, leaf in enumerate(tree.walk(q)):
                    if n >= visits and met > k:
                        break
                    if filled.get(leaf):
                        met += filled[leaf]
                        leaves.append(leaf)
                rows.append(leaves)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int64()))], ["query_id", "q", "leaves"])

    # one row for each query, so that its vector is staged once
    walked = staged(queries.mapInArrow(walks, "query_id long, q binary, leaves array<long>"), "visits")
    visitors = {r.leaf: r["count"] for r in walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()}
    blocks = spark.createDataFrame([(leaf, -(-n // BLOCK), -(-visitors.get(leaf, 0) // GROUP)) for leaf, n in sorted(filled.items())],
                                   "leaf long, blocks int, groups int")  # one row for each leaf
    # blocks and groups by hash; each of a leaf's groups of queries meets each of its blocks
    visited = (walked.select("query_id", "q", F.explode("leaves").alias("leaf")).join(F.broadcast(blocks), "leaf").withColumn("part", F.expr("cast(pmod(xxhash64(query_id), groups) as int)"))
               .select("leaf", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "part", "query_id", "q"))
    held = (placed.join(F.broadcast(blocks), "leaf").where("groups > 0").withColumn("block", F.expr("cast(pmod(xxhash64(id, v), blocks) as int)"))
            .select("leaf", "block", F.explode(F.expr("sequence(0, groups - 1)")).alias("part"), "id", "v"))
    keys = ["leaf", "block", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_table([])
        return found_table(best(left["query_id"].to_numpy(), matrix(left["q"]), right["id"].to_numpy(), matrix(right["v"]), k))

    found = visited.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(search, FOUND)
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
