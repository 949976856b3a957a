"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``VNODES`` points on a ring of 2^32 positions; a key belongs to
the first point at or after its own position.  A shard takes ``n div shards``
rows, the first ``n mod shards`` shards one more, so counts differ by one at most
(law ``rows``).  A point first serves the keys of its own arc, in ring order; what
does not fit walks on clockwise, first come, first served, and takes the place
that later points have left.  Two rounds of the ring always suffice, because the
places equal the keys.

The walk needs counts only, one for each arc (``shards * VNODES`` of them,
whatever the input): it is one SQL ``aggregate`` over the sorted counts.  It
yields intervals ``(arc, from, to) -> shard, first slot`` of key ranks inside an
arc, and rows find their interval by an equi-join on the arc.  Ranks come from
counted ranges of (arc, position, id, checksum), so neither a full arc nor an id
with a third of all rows meets in one task; the texts themselves are not
shuffled, only their size and checksum.

Null ids lie at the position of the empty string, null texts have 0 bytes, and
repeated rows count as rows of their own.  No rows give no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import placed, staged, table

SHARDS = 40
VNODES = 48
ROW_BYTES = 16  # counted for a row besides its text
RING = 1 << 32


def ring_position(key: Column) -> Column:
    """The first 32 bits of the key's MD5 digest."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """``(arc, low, high, owner)`` for every point, in ring order; an arc is ``[low, high)``.

    The keys after the last point belong to the first; they form a last arc of
    their own with the same owner.
    """
    points = (
        spark.range(shards * vnodes)
        .select((F.col("id") % shards).cast("int").alias("owner"), F.floor(F.col("id") / shards).alias("copy"))
        .select("owner", ring_position(F.concat_ws("-", F.lit("shard"), "owner", "copy")).alias("at"))
    )
    # at most shards * vnodes structs, in one array
    ring = points.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "owner"))).alias("p"))
    n = F.size("p")
    return ring.select(F.posexplode(F.expr(
        "transform(sequence(0, size(p)), i -> named_struct("
        "'low', if(i = 0, 0L, element_at(p, i).at + 1), "
        f"'high', if(i = size(p), {RING}L, element_at(p, i + 1).at + 1), "
        "'owner', if(i = size(p), element_at(p, 1).owner, element_at(p, i + 1).owner)))")).alias("arc", "x")).select("arc", "x.*")


# The walk: state is what each shard can still take, how many keys wait, how many have waited
# and been served, and the intervals given out.  The first lap offers each arc's own keys, then those that wait.
WALK = """
aggregate(
  concat(arcs, transform(arcs, a -> named_struct('arc', a.arc, 'owner', a.owner, 'n', 0L))),
  named_struct('room', transform(sequence(0, {shards} - 1), s -> total div {shards} + if(s < total % {shards}, 1L, 0L)),
               'used', transform(sequence(0, {shards} - 1), s -> 0L), 'queued', 0L, 'served', 0L,
               'own', cast(array() as array<struct<arc:int,k:bigint,shard:int,slot:bigint,before:bigint,n:bigint>>),
               'late', cast(array() as array<struct<p:bigint,k:bigint,shard:int,slot:bigint>>)),
  (s, a) -> transform(array(named_struct(
      'mine', least(a.n, element_at(s.room, a.owner + 1)),
      'old', least(s.queued - s.served, element_at(s.room, a.owner + 1) - least(a.n, element_at(s.room, a.owner + 1))))),
    t -> named_struct(
      'room', transform(s.room, (r, i) -> if(i = a.owner, r - t.mine - t.old, r)),
      'used', transform(s.used, (u, i) -> if(i = a.owner, u + t.mine + t.old, u)),
      'queued', s.queued + a.n - t.mine, 'served', s.served + t.old,
      'own', if(a.n > 0, concat(s.own, array(named_struct('arc', a.arc, 'k', t.mine, 'shard', a.owner,
             'slot', element_at(s.used, a.owner + 1), 'before', s.queued, 'n', a.n))), s.own),
      'late', if(t.old > 0, concat(s.late, array(named_struct('p', s.served, 'k', t.old, 'shard', a.owner,
             'slot', element_at(s.used, a.owner + 1) + t.mine))), s.late)))[0],
  s -> named_struct('own', s.own, 'late', s.late))
"""


def place(counts: DataFrame, shards: int) -> DataFrame:
    """``(arc, lo, hi, shard, slot)``: ranks ``[lo, hi)`` of an arc go to ``shard`` from ``slot`` on.

    ``counts`` holds ``(arc, owner, n)`` for every arc of the ring.
    """
    one = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct("arc", "owner", "n"))).alias("arcs"),
                               F.sum("n").alias("total"))
    walked = one.select(F.expr(WALK.format(shards=shards)).alias("w"))
    own = walked.select(F.explode("w.own").alias("o"), F.col("w.late").alias("late"))
    # keys at home; and the part of an arc's waiting keys that each later place serves
    return own.select(F.explode(F.expr(
        "concat(filter(array(named_struct('arc', o.arc, 'lo', 0L, 'hi', o.k, 'shard', o.shard, 'slot', o.slot)), x -> x.hi > 0), "
        "transform(filter(late, l -> l.p < o.before + o.n - o.k and l.p + l.k > o.before), l -> named_struct("
        "'arc', o.arc, 'lo', o.k + greatest(l.p - o.before, 0L), 'hi', o.k + least(l.p + l.k - o.before, o.n - o.k), "
        "'shard', l.shard, 'slot', l.slot + greatest(o.before - l.p, 0L))))")).alias("x")).select("x.*")


def ring_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """``(key, size, text_crc32, shard, slot)`` for every row of ``docs``."""
    spark = docs.sparkSession
    bytes_ = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).alias("_key"), (F.octet_length(bytes_) + ROW_BYTES).cast("bigint").alias("size"),
                       F.crc32(bytes_).alias("text_crc32"), ring_position(F.col(key)).alias("_at"))
    points = staged(ring_points(spark, shards, vnodes), "ring")
    # the arc of a position by its high bits: an arc lies in the few slices it touches
    slice_ = RING // 4096
    by_slice = points.select("arc", "low", "high", F.explode(F.sequence(
        F.expr(f"low div {slice_}"), F.expr(f"greatest(high - 1, low) div {slice_}"))).alias("_slice"))
    rows = (
        rows.withColumn("_slice", F.expr(f"_at div {slice_}"))
        .join(F.broadcast(by_slice), "_slice")  # shards * vnodes + 4096 rows at most
        .where("_at >= low and _at < high")
        .select("_key", "size", "text_crc32", "_at", "arc"))
    ranked = staged(placed(rows, "arc", ["_at", "_key", "text_crc32", "size"]), "ranks")
    in_arc = ranked.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    counts = points.join(in_arc, "arc", "left").select("arc", "owner", F.coalesce(in_arc.n, F.lit(0)).alias("n"))
    plan = staged(place(counts, shards), "plan")
    # the plan has at most 3 * (arcs + 1) intervals
    return (ranked.join(F.broadcast(plan), "arc").where("idx >= lo and idx < hi")
            .select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("slot") + F.col("idx") - F.col("lo")).alias("slot")))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ring_shards(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                    F.lit(None).cast("int").alias("grown_shard"))

