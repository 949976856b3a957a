"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A window is ``WINDOW`` consecutive words of a benchmark item, or the whole of a shorter
item.  Its shingles of ``SHINGLE`` words (of all its words where it has fewer) are a
set that a document must hold completely.  A first pass counts how often each of
these shingles occurs in all documents.  Shingles are ordered by that count; as
containment is complete, the necessary prefix of a window is its rarest shingle, and a
window with a shingle that occurs nowhere is done with.  A second pass joins the
prefix shingles with all places of all documents, applies the bounds on length and
position (the window must begin and end inside the document), and compares the words
of the window with those of the document.

Scale: documents are never shuffled before they are matched; the benchmark's shingles
and prefixes are joined as broadcast tables of at most ``BROADCAST_ROWS`` rows, a
larger benchmark in as many blocks as that takes.  A passage that many documents hold
costs a row for each of its places.  Windows that belong to the same items share one
item set, and documents with the same item sets share one list of items, so a passage
common to many documents and many items is not multiplied out.

Nulls and empty texts have no words and are hit by nothing; a benchmark row without an
id is an item named by the empty string, rows that repeat an item id are one item.
Repeated documents come out once for each row.  Texts are read whole, whatever their
length; one document's words and hits are held by one task.  An empty benchmark hits
nothing, an empty table of documents gives no rows.  Columns other than id and text are not
read, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostercast.llm.common import staged, table

WINDOW = 10
SHINGLE = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000  # about 60 MB of windows of ten words
ITEM_SET = ("n_of_set", "xor_of_set", "sum_of_set")


def words_of(text: str) -> Column:
    """The words of a text, A to Z lower-cased."""
    return F.coalesce(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(hashes: str, size: int) -> Column:
    """A 64-bit hash of every ``size`` consecutive words by their hashes; null where fewer follow."""
    def one(h: Column, i: Column) -> Column:
        rest = [F.get(F.col(hashes), i + j) for j in range(1, size)]
        return F.when(i + size <= F.size(hashes), F.xxhash64(F.lit(size), h, *rest))

    return F.transform(hashes, one)


def windows_of(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(item, window)`` of every item, each once; an item with fewer words is one window."""
    words = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words_of(text).alias("words"))
    starts = F.sequence(F.lit(1), F.size("words") - F.lit(size - 1))
    cut = (F.when(F.size("words") >= size, F.transform(starts, lambda i: F.slice("words", i, size)))
           .when(F.size("words") > 0, F.array("words")))
    return words.select("item", F.explode_outer(cut).alias("window")).where("window is not null").distinct()


def window_table(pairs: DataFrame) -> DataFrame:
    """Every window once: its shingles, their size, and the set of its items by count and two order-free hashes."""
    item = F.xxhash64("item")
    found = pairs.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_of_set"), F.bit_xor(item).alias("xor_of_set"),
        F.sum(F.pmod(F.xxhash64("item", F.lit(1)), F.lit(2 ** 31))).alias("sum_of_set"))
    hashed = found.withColumns({"hashes": F.transform("window", lambda w: F.xxhash64(w)), "size": F.least(F.size("window"), F.lit(SHINGLE))})
    tokens = F.coalesce(*[F.when(F.col("size") == k, F.filter(shingles("hashes", k), lambda t: t.isNotNull())) for k in range(1, SHINGLE + 1)])
    return hashed.select("window", "size", *ITEM_SET, tokens.alias("tokens"))


def places(docs: DataFrame, sizes: list[int], last: bool) -> DataFrame:
    """``docs`` ``(…, words, hashes)`` with every shingle of every size: ``(e, token)``; with ``last`` one more row, token 0."""
    lists = [shingles("hashes", k) for k in sizes]
    if last:
        lists.append(F.array(F.lit(0).cast("long")))
    kept = [c for c in docs.columns if c != "hashes"]
    # outer: Spark would filter empty arrays before the projection, and find the words of a text anew for every word
    return docs.select(*kept, F.concat(*lists).alias("_all")).select(*kept, F.posexplode_outer("_all").alias("e", "token"))


def blocks(df: DataFrame, rows: int, by: Column) -> list[DataFrame]:
    """``df`` in parts of about ``BROADCAST_ROWS`` rows."""
    n = max(1, math.ceil(rows / BROADCAST_ROWS))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def rarity(hashed: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """``(token, occurs)`` for every shingle of the benchmark that occurs in the documents."""
    tokens = staged(windows.select(F.explode("tokens").alias("token")).distinct(), "tokens")
    here = places(hashed.select("hashes"), sizes, False).select("token")
    parts = [here.join(F.broadcast(b), "token").groupBy("token").agg(F.count(F.lit(1)).alias("occurs"))
             for b in blocks(tokens, tokens.count(), F.col("token"))]
    return reduce(DataFrame.unionByName, parts)


def prefixes(windows: DataFrame, occurs: DataFrame) -> DataFrame:
    """The rarest shingle of every window that has all its shingles somewhere, and its place in the window."""
    each = windows.select("window", "size", *ITEM_SET, F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("at", "token"))
    rarest = each.join(occurs, "token").groupBy("window").agg(
        F.count(F.lit(1)).alias("found"), F.min(F.struct("occurs", "token", "at")).alias("least"), F.first("n_tokens").alias("n_tokens"),
        F.first("size").alias("size"), *[F.first(c).alias(c) for c in ITEM_SET])
    return rarest.where("found = n_tokens").select("window", "size", *ITEM_SET, F.col("least.token").alias("token"), F.col("least.at").alias("at"))


def occurrences(hashed: DataFrame, first: DataFrame, sizes: list[int]) -> DataFrame:
    """``(_key, _text, _part, n_words, span, item_set)`` for every occurrence, and a row without span for every document."""
    spark = hashed.sparkSession
    # token 0, met by the last place of every document
    fixed = {"token": F.lit(0), "at": F.lit(0)}
    every = spark.range(1).select(*[fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in first.schema])
    length = F.size("window")
    start = (F.col("e") % F.greatest("n_words", F.lit(1)) - F.col("at")).cast("int")
    inside = (F.col("start") >= 0) & (F.col("start") + length <= F.col("n_words"))
    place = F.col("e") < len(sizes) * F.col("n_words")
    out = []
    for i, block in enumerate(blocks(first, first.count(), F.col("window"))):
        met = places(hashed, sizes, i == 0).join(F.broadcast(block.unionByName(every) if i == 0 else block), "token").withColumn("start", start)
        same = F.col("window").isNotNull() & place & inside & (F.slice("words", F.col("start") + 1, length) == F.col("window"))
        own = F.col("window").isNull() & ~place
        out.append(met.where(same | own).select(
            "_key", "_text", "_part", "n_words", F.when(~own, F.struct("start", (F.col("start") + length).alias("end"))).alias("span"),
            F.when(~own, F.struct(*ITEM_SET)).alias("item_set")))
    return reduce(DataFrame.unionByName, out)


def item_lists(sets: DataFrame, pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """``(sets, items)`` for the distinct values of ``sets``, arrays of item sets: the sorted ids of all their items."""
    chosen = windows.groupBy(*ITEM_SET).agg(F.min("window").alias("window"))  # any window of a set names its items
    members = pairs.join(chosen, "window").select(F.struct(*ITEM_SET).alias("item_set"), "item")
    distinct = sets.distinct()
    named = distinct.select("sets", F.explode("sets").alias("item_set")).join(members, "item_set")
    return named.groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, n_words, spans, items)`` for every row of ``docs``.

    ``spans`` are the word places ``[start, end)`` of all occurrences, ``items`` the ids of all items with one, both sorted.
    """
    pairs = staged(windows_of(benchmark, item_key, item_text, window), "item-windows")
    windows = staged(window_table(pairs), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # SHINGLE values at most
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_text"), F.spark_partition_id().alias("_part"), words_of(text).alias("words"))
    hashed = rows.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "n_words": F.size("words").cast("long")})
    first = staged(prefixes(windows, rarity(hashed, windows, sizes)), "prefixes") if sizes else windows.select(
        "window", "size", *ITEM_SET, F.lit(0).cast("long").alias("token"), F.lit(0).alias("at"))
    met = occurrences(hashed, first, sizes).groupBy("_key", "_text", "_part", "n_words").agg(
        F.count_if(F.col("span").isNull()).cast("int").alias("copies"), F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.collect_set("item_set")).alias("sets"))
    met = staged(met.select(F.col("_key").alias(key), "n_words", "spans", "sets", "copies"), "hits")
    dirty = met.where(F.size("sets") > 0)
    named = staged(item_lists(dirty.select("sets"), pairs, windows), "item-lists")
    if named.count() <= BROADCAST_ROWS // 100:
        named = F.broadcast(named)
    clean = met.where(F.size("sets") == 0).withColumn("items", F.array().cast("array<string>"))
    # repeated rows of a partition again as many rows
    return clean.unionByName(dirty.join(named, "sets")).select(key, "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies"))).drop("col")


def covered(spans: str = "spans") -> Column:
    """Places under at least one of the sorted spans."""
    return F.expr(f"""aggregate({spans}, named_struct('upto', 0, 'n', 0L), (a, s) -> named_struct(
      'upto', greatest(a.upto, s.end), 'n', a.n + greatest(0, s.end - greatest(s.start, a.upto))), a -> a.n)""")


def op12_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = rf"""
WITH iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
pairs AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, w[p:p + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS p FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM pairs) WHERE len(w) >= k),
hits AS (SELECT doc_id, p, pl.k, item FROM places pl JOIN pairs ON pairs.k = pl.k AND pairs.win = pl.w[p:p + pl.k - 1]),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) FROM (SELECT DISTINCT doc_id, p, k FROM hits)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""
