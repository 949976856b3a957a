"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct ``words``-word shingles after lower-casing
A-Z (words: runs without ASCII white space; the whole sequence if it has fewer
words; empty without any).  Documents with the same word sequence are one node.

SuperMinHash gives every element a random permutation of the ``m`` places and lets
it offer ``j + r`` at its j-th place; the least offer stays.  All elements advance
together, and a document's elements stop as soon as every place is taken, because
later offers are larger.  The places are cut into bands of ``ROWS``; documents that
share a band's hash are candidates.  The number of bands keeps the chance that a
pair at the threshold shares none under ``MISS``.

Candidates are confirmed on the full shingle sets.  Inside a bucket only stars are
compared, never all pairs: first every document with that least document of its
buckets with which it shares most of them, then, in buckets that still hold several
components, once more with that document which a hash draws from each bucket, and
after that with a hashed share of the members that grows eightfold each round until
it holds all of them.  The hashes are of the document alone, so the many buckets that
a group of copies has draw the same members, not others in each bucket.  Before these,
pairs that share a rare shingle (one that at most ``RARE`` of the documents in such
buckets have) are compared; any other pair can have in common only what is left
after both lose their rare shingles.  Pairs are left out if they are known to be
connected, were compared before, or cannot meet the threshold, because of their
sizes or because of their rare shingles (a copy with too many changes links with
nothing, however many copies there are).  So no candidate link between different
components is lost, and large groups of copies cost a few rounds of linear size.

Null and empty texts have no shingles and are linked with nothing, and so are rows
without an id; repeated rows count once as nodes and come out as often as they
came in; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import connected_components, staged, table

WORDS, SHARE = 3, 85  # per cent of the union that both must hold
ROWS, MISS = 5, 1e-7
CHUNK = 100_000  # shingles that go through SuperMinHash together
GROWTH = 8
RARE = 64
HEAVY = 4096  # a bucket with this part of all members or more is heavy; there are at most so many

FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)


def band_count(share: int) -> int:
    """The least number of bands that misses a pair at the threshold with a chance under ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (share / 100) ** ROWS))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh3_64_intdigest

    if len(words) < size:
        return np.array([xxh3_64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n, out = len(h) - size + 1, np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = mixed(out * STEP + h[i : i + n])
    return np.unique(out)


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` places for each set; ``FREE`` everywhere for an empty one."""
    out = np.full((len(sets), m), FREE)
    sizes = np.array([len(s) for s in sets])
    for a, b in chunks(sizes):
        element = np.concatenate(sets[a:b]) if b > a else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(b - a), sizes[a:b])
        own, swaps = out[a:b], None
        for j in range(m):
            x = mixed(element + np.uint64((j + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF))
            place = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.intp)
            if j == 0:
                first = place
            else:
                if swaps is None:  # the permutations of the elements that go on, after their first swap
                    swaps = np.tile(np.arange(m, dtype=np.uint16), (len(element), 1))
                    swaps[np.arange(len(element)), first] = 0
                rows = np.arange(len(element))
                at = place
                place = swaps[rows, at].astype(np.intp)
                swaps[rows, at] = swaps[rows, j]
            np.minimum.at(own.reshape(-1), doc * m + place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
            on = (own == FREE).any(axis=1)[doc]
            if not on.any():
                break
            if not on.all():
                element, doc = element[on], doc[on]
                if j == 0:
                    first = first[on]
                else:
                    swaps = swaps[on]
    return out


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring sets of about ``CHUNK`` elements together (at least one set)."""
    a, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and total + n > CHUNK:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Some rows at a time: the words of a whole batch as Python objects would take much memory."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    d, m = signatures.shape
    parts = signatures.reshape(d, m // ROWS, ROWS)
    h = np.tile(np.arange(m // ROWS, dtype=np.uint64), (d, 1))
    for i in range(ROWS):
        h = mixed(h * STEP + parts[:, :, i])
    return h.view(np.int64)


def signature_table(docs: DataFrame, key: str, text: str, words: int, share: int) -> DataFrame:
    """``(doc_id, n, sequence, bands)``: shingles, a 128-bit hash of the word sequence, band hashes."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        m = band_count(share) * ROWS
        for batch in pieces_of(batches):
            tokens = [(t.as_py() or "").encode().lower().split() for t in batch.column(1)]
            sets = [shingles(w, words) for w in tokens]
            bands = band_hashes(superminhash(sets, m))
            flat = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1], bands.reshape(-1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxh3_128_digest(b" ".join(w)) for w in tokens], pa.binary()), flat], ["doc_id", "n", "sequence", "bands"])

    return staged(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
                  .mapInArrow(signed, "doc_id long, n long, sequence binary, bands array<long>"), "signatures")


def shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``(id, s)``: the shingle sets of the documents ``ids`` as 64-bit hashes, staged; the one time that texts are shuffled."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            own = [shingles((t.as_py() or "").encode().lower().split(), words).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["id", "s"])

    # a merge join at every size: the ids grow with the documents
    return staged(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(ids.hint("merge"), "id")
                  .mapInArrow(sets, "id long, s binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets meet the threshold, as a staged table."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= share * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return staged(pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a")
                  .join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
                  .select("a", "b", "x", "y").mapInArrow(meet, "a long, b long"), "links")


def with_bucket(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """``members`` joined with the one row of their bucket; ``buckets`` has ``band`` and ``size``, its number of members.

    Heavy buckets, ``HEAVY`` at most as their sizes sum to the members, are broadcast and their members stay where they
    are; only those of the other buckets are shuffled, so no task gets a large part of the rows.  The hashes of the heavy
    buckets filter the others' members by value; without heavy buckets one join does.
    """
    heavy = staged(buckets.where(F.col("size") * HEAVY >= members.count()), "heavy")
    hashes = [r["band"] for r in heavy.select("band").collect()]
    light = members.where(~F.col("band").isin(hashes)).join(buckets, "band")
    return members.join(F.broadcast(heavy), "band").unionByName(light) if hashes else light


def nearest(stars: DataFrame) -> DataFrame:
    """``(a, b)`` from rows ``(a, b)`` for each bucket that two documents share: for each ``a`` that ``b`` with which it shares most."""
    return (stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
            .groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")))


def rare_shingles(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """``(doc_id, s)``: the shingles of documents ``ids`` that ``RARE`` of them have at most, staged."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            own = [np.frombuffer(v.as_py(), np.int64) for v in batch.column(1)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])),
                                                  pa.array(np.concatenate(own))], ["doc_id", "s"])

    held = sets.join(ids.select(F.col("doc_id").alias("id")), "id").mapInArrow(rows, "doc_id long, s long")
    few = held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE).select("s")
    return staged(held.join(few, "s"), "rare")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row."""
    signed = signature_table(docs, key, text, words, share)
    nodes = staged(signed.where("n > 0 and doc_id is not null").groupBy("sequence").agg(F.min("doc_id").alias("node")), "nodes")
    first = staged(signed.join(nodes.select("sequence", F.col("node").alias("doc_id")), ["sequence", "doc_id"])
                   .select("doc_id", "n", "bands").distinct(), "first")
    members = first.select("doc_id", "n", F.explode("bands").alias("band"))
    close = f"100 * least(n, nb) >= {share} * greatest(n, nb)"

    # buckets of several documents, and the least document of each
    least = (members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("b"), F.min_by("n", "doc_id").alias("nb"))
             .where("size > 1"))
    members = staged(with_bucket(members, staged(least, "least")), "buckets")
    sets = shingle_sets(docs, members.select(F.col("doc_id").alias("id")).distinct(), key, text, words)
    done = staged(nearest(members.where(f"doc_id <> b and {close}").select(F.col("doc_id").alias("a"), "b"))
                  .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    root = connected_components(confirmed(done, sets, share), "a", "b")

    def joined(pairs: DataFrame) -> None:
        """Confirm pairs of different components that were not compared before, and join what is linked."""
        nonlocal done, root
        new = staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                     .join(done, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            return
        found = confirmed(new, sets, share)
        done = done.union(new)
        if not found.isEmpty():
            # what was linked before stands as one edge for each node, not as all its links
            root = connected_components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found), "a", "b")

    def with_root(rows: DataFrame) -> DataFrame:
        return (rows.join(root.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
                .withColumn("root", F.coalesce("root", "doc_id")))

    def still_open(rows: DataFrame, hubs: bool = False) -> DataFrame:
        """The members of buckets that hold several components, with their roots; if asked for, ``hub`` is a member drawn by its hash."""
        own = staged(with_root(rows), "rooted")
        hub = [F.min_by(F.struct(*own.columns), F.xxhash64("doc_id", F.lit("hub"))).alias("hub")] * hubs
        several = (own.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), *hub)
                   .where("r0 <> r1").drop("r0", "r1"))
        return staged(with_bucket(own, staged(several, "several")), "open")

    open_ = still_open(members.select("doc_id", "n", "band"))
    if not open_.isEmpty():
        ids = staged(open_.select("doc_id", "n", "root").distinct(), "ids")
        rare = rare_shingles(ids.select("doc_id"), sets)
        # documents with their number of rare shingles, for either side of a pair
        known = staged(ids.join(rare.groupBy("doc_id").agg(F.count(F.lit(1)).alias("r")), "doc_id", "left").withColumn("r", F.coalesce("r", F.lit(0))), "known")
        a_side = known.select(F.col("doc_id").alias("a"), "n", "r", "root")
        b_side = known.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("root").alias("rootb"))
        # pairs that share a rare shingle: RARE partners for each at most
        first_of, second_of = rare.select(F.col("doc_id").alias("a"), "s"), rare.select(F.col("doc_id").alias("b"), "s")
        both = "least(n - r, nb - rb) + shared"  # shingles that both can hold
        joined(first_of.join(second_of, "s").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
               .join(a_side, "a").join(b_side, "b")
               .where(f"root <> rootb and {close} and 100 * ({both}) >= {share} * (n + nb - ({both}))"))
        # the others share none: what is left after their rare shingles must do
        rest = staged(open_.select("doc_id", "band").join(known.drop("root"), "doc_id").where(f"100 * (n - r) >= {share} * n"), "rest")
        most = "least(n - r, nb - rb)"
        may_link = f"root <> rootb and 100 * {most} >= {share} * (n + nb - {most})"
        stars = still_open(rest, hubs=True).select(F.col("doc_id").alias("a"), "n", "r", "root", F.col("hub.doc_id").alias("b"),
                                                   F.col("hub.n").alias("nb"), F.col("hub.r").alias("rb"), F.col("hub.root").alias("rootb"))
        joined(nearest(stars.where(may_link).select("a", "b")))
        share_of = GROWTH
        while True:
            open_ = still_open(rest)
            largest = open_.agg(F.max("size")).first()[0]
            if largest is None:
                break
            chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("size") < share_of * (1 << 20)
            some = open_.where(chance).select("band", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("root").alias("rootb"))
            joined(open_.join(some, "band").where(may_link).select(F.col("doc_id").alias("a"), "b"))
            if share_of >= largest:
                break
            share_of *= GROWTH
    out = (signed.select("doc_id", "n", "sequence").join(nodes, "sequence", "left")
           .join(root, "node", "left"))
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    return (out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {SHARE} * (na.n + nb.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
