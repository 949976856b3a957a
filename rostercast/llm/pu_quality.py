"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1 outside the held-out fold; the other
documents of the training folds serve as unlabelled text, whatever their labels.
A small network minimises the non-negative unbiased risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P))

over hashed samples of both (``MAX_ROWS`` different rows of id and text each, the documented bound).  The class
prior is estimated first: a network that tells P from U ranks held-back halves of
both, and the least ratio of the shares of U and P above a score, over all scores
with enough positives, bounds the share of positives in U.

Features are shapes only, from the whole text: bytes by kind, pairs of neighbouring
kinds, word lengths, repetition of words, word pairs and lines.  Labels, language,
source and ids are no features.

Null texts count as empty and are scored like them; repeated rows get equal scores;
without trusted positives nothing speaks against a document and every score is 0.7;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostercast.llm.common import row_sample, sliced, table

MAX_ROWS = 16_000  # of either sample, on average; a few hundred more can come by chance
THRESHOLD = 0.7
HELD_OUT, FOLDS = 2, 4
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 512, 5e-3

# byte kinds: space, line end, lower, upper, digit, sentence sign, other sign, beyond ASCII
KIND = np.full(256, 6, np.uint8)
KIND[128:] = 7
KIND[[32, 9]], KIND[[10, 13]] = 0, 1
KIND[97:123], KIND[65:91], KIND[48:58] = 2, 3, 4
KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
KINDS = 8
WIDTH = KINDS * KINDS + KINDS + 9


def features(text: str) -> np.ndarray:
    raw = text.encode()
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    kind = KIND[np.frombuffer(raw, np.uint8)]
    pairs = np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
    out[: KINDS * KINDS] = np.sqrt(pairs / len(raw))
    out[KINDS * KINDS : KINDS * KINDS + KINDS] = np.bincount(kind, minlength=KINDS) / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float32, len(words)) if words else np.zeros(1, np.float32)
    out[-9:] = (
        math.log1p(len(raw)), math.log1p(n), sizes.mean(), sizes.std(), sizes.max() ** 0.5, len(set(words)) / n,
        len(set(zip(words, words[1:]))) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / len(lines))
    return out


class Network:
    """One hidden layer, Adam; ``scores`` are probabilities."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, std
        self.w = [rng.normal(0, 1 / math.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w], 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        self.x = np.clip((x - self.mean) / self.std, -8, 8)
        self.h = np.tanh(self.x @ self.w[0] + self.w[1])
        return self.h @ self.w[2] + self.w[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def step(self, slope: np.ndarray) -> None:
        """One Adam step along the slopes of the last logits."""
        down = slope[:, None] * self.w[2] * (1 - self.h**2)
        grads = [self.x.T @ down + 1e-4 * self.w[0], down.sum(0), self.h.T @ slope + 1e-4 * self.w[2], np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] -= RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def risk_slope(sp: np.ndarray, su: np.ndarray, prior: float | None) -> np.ndarray:
    """Slopes of the risk in the logits of the scores ``sp`` of positives and ``su`` of unlabelled rows."""
    if prior is None:
        return np.concatenate([(sp - 1) / len(sp), su / len(su)])
    negative = -np.log(np.maximum(1 - su, 1e-12)).mean() - prior * -np.log(np.maximum(1 - sp, 1e-12)).mean()
    if negative >= 0:
        return np.concatenate([prior * ((sp - 1) - sp) / len(sp), su / len(su)])
    return np.concatenate([prior * sp / len(sp), -su / len(su)])  # the risk on negatives must not fall under 0: step back from there


def train(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Non-negative risk with ``prior``; plain P against U if that is None."""
    net, rng = Network(u.mean(0), u.std(0) + 1e-3, seed), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for a in range(0, len(u), BATCH):
            xu = u[order[a : a + BATCH]]
            xp = p[rng.integers(0, len(p), min(BATCH, len(p)))]
            s = net.scores(np.concatenate([xp, xu]))
            slope = risk_slope(s[: len(xp)], s[len(xp) :], prior)
            net.step(slope)
    return net


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in ``u``: the least ratio of the shares above a score (best bin), on held-back halves."""
    net = train(p[::2], u[::2], None, EPOCHS // 2)
    sp, su = np.sort(net.scores(p[1::2])), np.sort(net.scores(u[1::2]))
    if not len(sp) or not len(su):
        return 0.5
    cuts = sp
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = math.sqrt(math.log(20) / (2 * len(sp))) + math.sqrt(math.log(20) / (2 * len(su)))
    best = np.argmin((qu + slack) / qp)
    return float(np.clip(qu[best] / qp[best], 0.02, 0.98))


def crc(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0))


def feature_rows(texts: DataFrame) -> np.ndarray:
    """Features of a sample's texts, ordered so that equal samples give equal arrays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py() or "").tobytes() for t in b.column(0)], pa.binary())], ["f"])

    got = sorted(bytes(r.f) for r in texts.mapInArrow(rows, "f binary").collect())
    x = np.frombuffer(b"".join(got), np.float32).reshape(-1, WIDTH)
    return x[np.random.default_rng(1).permutation(len(x))]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Network | None:
    """The classifier for ``docs``, or None without trusted positives."""
    train_fold = crc(F.col(key)) % FOLDS != HELD_OUT
    trusted = row_sample(labels.where((F.col("quality") == 1) & train_fold).select(key), MAX_ROWS)  # about MAX_ROWS ids
    texts = docs.select(F.col(key), F.col(text).alias("t"))
    p = feature_rows(row_sample(texts.join(F.broadcast(trusted), key), MAX_ROWS).select("t"))
    u = feature_rows(row_sample(texts.where(train_fold), MAX_ROWS).select("t"))
    if not len(p) or not len(u):
        return None
    return train(p, u, class_prior(p, u))


def score(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``(doc, score)``: the columns ``keep`` of every row (all by default) as a struct, and its score."""
    kept = list(keep or docs.columns)
    # the text travels once: inside the struct where that holds it
    inside = kept.index(text) if text in kept else None
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), *([F.col(f"`{text}`").alias("t")] if inside is None else []))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = np.full(b.num_rows, THRESHOLD)
            if net is not None:
                texts = b.column(1) if inside is None else b.column(0).field(inside)
                s = net.scores(np.stack([features(t.as_py() or "") for t in texts]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc", "score"])

    return row.mapInArrow(scores, T.StructType([T.StructField("doc", row.schema["doc"].dataType), T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    return score(docs, fit(docs, labels, key, text), text).where(F.col("score") >= THRESHOLD).select("doc.*")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, fit(docs, labels), keep=["doc_id"]).select(
        "doc.doc_id", (crc(F.col("doc.doc_id")) % FOLDS == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
