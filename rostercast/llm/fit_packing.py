"""Best-fit packing of documents into sequences by exact-complement hashing.

A document's ids end with an end id.  Only documents longer than ``SEQUENCE`` are
cut: into pieces of ``SEQUENCE`` ids, the first one taking what is left over.

How many pieces of each length there are (``SEQUENCE`` counts at most, whatever
the input) decides the packing, so it is planned on counts: for each length, from
long to short, combinations of one, two or three shorter lengths that fill its gap
exactly are looked up by their sum in an index of the singles, pairs and triples that are
available, and consumed as often as all of their lengths are; the index follows the counts.  What has no exact complement goes, from long to short, to the open
sequence with the smallest gap that still takes it, and only then to a new one.
Pairs and triples can spend short pieces that best fit would have used better, so
the plan is made for combinations of up to three, two and one, and the one with
the fewest sequences is carried out.
Every step uses up a length or a kind of open sequence, so the plan is a bounded
list of patterns, each with a number of sequences.

The plan gives every length its intervals of ranks; a piece's rank is its place
among the pieces of that length in its task plus the counts of the tasks before,
so that no group of equal lengths, however large, meets in one task.

Null and empty texts are documents of one id; repeated rows are documents of
their own; no rows give no sequences.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostercast.llm.common import sliced, staged, table
from rostercast.llm.tokens import END_ID, MAX_WORDS, vocabulary_path, word_ids

SEQUENCE = 1024


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of a document of ``n`` ids."""
    first = n % size or min(n, size)
    return [(0, first), *((a, a + size) for a in range(first, n, size))]


class Complements:
    """Available lengths, and an index from a sum to the singles, pairs and triples of them that make it.

    ``n[s]`` counts the single length ``s``.  ``pairs[s, a]`` says that the pair ``(a, s - a)``, a the shorter, is
    available, and ``longest[s]`` is the largest such ``a`` (0: none).  A triple of sum ``s`` is its shortest
    length ``c`` with a pair of sum ``s - c`` and no member under ``c``, so ``longest[s - c]`` tells for all ``c`` at
    once which triples there are.  Only whether a length is there once, twice or three times matters; the index is
    brought up to date whenever a count crosses one of these.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.n = np.zeros(size + 1, np.int64)
        for length, k in counts.items():
            self.n[length] = k
        there = self.n > 0
        total, a = np.arange(size + 1)[:, None], np.arange(size // 2 + 1)[None, :]
        b = np.maximum(total - a, 0)
        self.pairs = there[a] & there[b] & (a > 0) & (a <= b) & ((a < b) | (self.n[a] > 1))
        self.longest = (self.pairs * a).max(axis=1)

    def put(self, x: int, count: int) -> None:
        """Set the count of length ``x`` and bring the pairs that it is part of up to date."""
        before, self.n[x] = self.n[x], count
        if min(before, 2) == min(count, 2):
            return
        other = np.arange(1, self.size - x + 1)
        total, short = other + x, np.minimum(other, x)
        now = (self.n[other] > 0) & (count > 0) & ((other != x) | (count > 1))
        gone = total[~now & (self.longest[total] == short) & self.pairs[total, short]]
        self.pairs[total, short] = now
        self.longest[total[now]] = np.maximum(self.longest[total[now]], short[now])
        last = self.pairs[gone, ::-1].argmax(axis=1)
        self.longest[gone] = np.where(self.pairs[gone].any(axis=1), self.pairs.shape[1] - 1 - last, 0)

    def pair(self, total: int, least: int = 1) -> tuple[int, int] | None:
        """The pair with the longest member, no member under ``least``."""
        if self.longest[total] < least:
            return None
        a = least + int(self.pairs[total, least:].argmax())
        return total - a, a

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The triple with the smallest shortest member, and with the longest member among these."""
        c = np.arange(1, total // 3 + 1)
        b = total - 2 * c  # the longest of (c, c, b)
        twice = (self.n[c] > 1) & (self.n[b] > 0) & ((b != c) | (self.n[c] > 2))
        found = np.flatnonzero((self.n[c] > 0) & ((self.longest[total - c] > c) | twice))
        if not len(found):
            return None
        at = int(found[0])
        x = int(c[at])
        return (int(b[at]), x, x) if twice[at] else (*self.pair(total - x, x + 1), x)

    def find(self, gap: int, parts: int = 3) -> tuple[int, ...] | None:
        """A combination of at most ``parts`` available lengths whose sum is ``gap``."""
        if gap > 0 and self.n[gap]:
            return (gap,)
        return (self.pair(gap) if parts > 1 else None) or (self.triple(gap) if parts > 2 else None)

    def take(self, lengths: tuple[int, ...]) -> int:
        """How often the combination is available; those pieces are used up."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(self.n[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.put(x, int(self.n[x]) - times * k)
        return times


Patterns = list[tuple[tuple[int, ...], int]]


def plan_patterns(counts: dict[int, int], size: int = SEQUENCE) -> Patterns:
    """``(lengths, sequences)``: patterns that use every piece exactly once.

    Complements of up to three, two and one lengths are planned; the plan with the
    fewest sequences is taken, the first one that reaches the lower bound ends the search.
    """
    least = -(-sum(x * k for x, k in counts.items()) // size)
    best: Patterns | None = None
    for parts in (3, 2, 1):
        plan = plan_with(counts, size, parts)
        if best is None or sum(k for _, k in plan) < sum(k for _, k in best):
            best = plan
        if sum(k for _, k in best) == least:
            break
    return best


def plan_with(counts: dict[int, int], size: int, parts: int) -> Patterns:
    """One plan, with exact complements of at most ``parts`` lengths."""
    left = Complements(counts, size)
    patterns: Patterns = []
    if left.n[size]:
        patterns.append(((size,), left.take((size,))))
    for length in range(size - 1, 0, -1):
        while left.n[length]:
            here = int(left.n[length])
            left.put(length, here - 1)  # the piece itself is no part of its complement
            found = left.find(size - length, parts)
            left.put(length, here)
            if not found:
                break
            patterns.append(((length, *found), left.take((length, *found))))
    gaps: dict[int, list] = defaultdict(list)  # gap: [lengths, sequences] of the open ones
    for length in range(size - 1, 0, -1):
        k = int(left.n[length])
        while k:
            gap = min((g for g in gaps if g >= length), default=None)
            if gap is None:
                fit = size // length
                for each, times in ((fit, k // fit), (k % fit, 1)):
                    if each and times:
                        gaps[size - each * length].append([(length,) * each, times])
                break
            held, times = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            fit = gap // length
            for each, n in ((fit, min(times, k // fit)), (k % fit, 1)):
                n = min(n, times)
                if each and n and (each == fit or k < fit):
                    gaps[gap - each * length].append([held + (length,) * each, n])
                    k -= each * n
                    times -= n
            if times:
                gaps[gap].append([held, times])
    return patterns + [(held, times) for own in gaps.values() for held, times in own]


def plan_intervals(patterns: Patterns) -> dict[int, np.ndarray]:
    """By length: rows ``(first rank, first sequence, offset, copies in a sequence)`` in rank order."""
    used: dict[int, int] = defaultdict(int)
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            copies = lengths.count(x)
            rows[x].append((used[x], sequence, offset, copies))
            used[x] += copies * times
            offset += copies * x
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


def piece_table(docs: DataFrame, key: str, text: str, size: int, vocabulary: str, stored: int = MAX_WORDS) -> DataFrame:
    """Every piece with its place ``nth`` among the pieces of its length in its task ``part``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, part, end, seen = word_ids(vocabulary, stored), TaskContext.get().partitionId(), struct.pack("<I", END_ID), defaultdict(int)
        for batch in sliced(batches):
            out: list[tuple] = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = store.encode(t.as_py() or "") + end
                for i, (a, b) in enumerate(cut(len(ids) // 4, size)):
                    out.append((k, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), part, seen[b - a]))
                    seen[b - a] += 1
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    return staged(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(pieces, PIECES), "pieces")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SEQUENCE,
                   vocabulary: str | None = None, stored: int = MAX_WORDS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece.

    ``stored`` words in each of two generations keep their ids in a Python worker: fewer take less memory and more time.
    """
    pieces = piece_table(docs, key, text, size, vocabulary or vocabulary_path(), stored)
    each = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    base = each.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {r.length: r.n for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    intervals = plan_intervals(plan_patterns(counts, size))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows, own = intervals[x], length == x
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - at[:, 0]
                sequence[own] = at[:, 1] + nth // at[:, 3]
                offset[own] = at[:, 2] + nth % at[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(length, pa.int64()), batch.column(4),
                                              pa.array(sequence), pa.array(offset)], PLACED_NAMES)

    return (pieces.join(base, ["length", "part"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
            .mapInArrow(placed, PLACED))


PLACED_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def sequences(docs: DataFrame, placed: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(sequence_id, ids)``: the packed sequences themselves, for unique ids in ``docs``."""
    where = vocabulary or vocabulary_path()

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, end = word_ids(where), struct.pack("<I", END_ID)
        for batch in batches:
            t, a, n = (batch.column(i).to_pylist() for i in range(3))
            ids = [(store.encode(x or "") + end)[4 * i : 4 * (i + k)] for x, i, k in zip(t, a, n)]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(ids, pa.binary())], ["sequence_id", "offset", "ids"])

    pieces = (placed.join(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), "doc_id")
              .select("t", "start", "length", "sequence_id", "offset").mapInArrow(cut_out, "sequence_id long, offset long, ids binary"))
    # a sequence holds ``size`` ids at most
    return (pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids")))


def op2_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
