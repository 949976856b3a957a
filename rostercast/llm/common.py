"""Helpers shared by the corpus operators: tables, staged tables and connected components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostercast.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, so that
    later reads touch only the columns they need.  Lost executors cost nothing:
    the table is complete before anything reads it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, rows_each: int, rows: int) -> int:
    """Partitions for ``rows`` rows at ``rows_each`` a task, at least the session's shuffle partitions."""
    return max(partitions(df.sparkSession), math.ceil(rows / rows_each))


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``idx`` (from 0, by ``order``) and ``n`` (rows) within ``group``.

    Ranges of (group, order) are counted, so a group of any size is dealt over many tasks; a row's place is its place in its range
    plus the rows of the group in earlier ranges.
    """
    tied = staged(df.withColumn("_tie", F.monotonically_increasing_id()), "tied")
    keys = [group, *order, "_tie"]
    ranged = staged(tied.repartitionByRange(partitions(df.sparkSession), *keys)
                    .withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_here"))  # ranges + groups rows at most
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"_before": F.coalesce(F.sum("_here").over(earlier), F.lit(0)),
                                 "n": F.sum("_here").over(Window.partitionBy(group))}).drop("_here")
    local = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_tie"))
    return (ranged.withColumn("_local", local).join(starts, ["_part", group])
            .withColumn("idx", F.col("_before") + F.col("_local") - 1)
            .drop("_part", "_tie", "_local", "_before"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``rows`` rows, so that a worker works on few texts at a time.

    Memory of a batch that is done goes back to the system, as workers outlive their tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
        pa.default_memory_pool().release_unused()


def row_sample(rows: DataFrame, most: int) -> DataFrame:
    """Different rows of ``rows``: ``most`` of them on average, all if there are fewer.

    The draw is a hash of all columns, and the share follows from an estimate of how many different rows there are, so a
    row or an id that comes a million times neither fills the sample nor empties it.
    """
    h = F.xxhash64(F.lit("sample"), *[F.col(f"`{c}`") for c in rows.columns])
    different = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    share = min(1.0, most / max(different, 1))
    drawn = rows.withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.dropDuplicates(["_h"]).drop("_h")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Union-find as Spark joins: ``(node, root)`` for every node of ``edges``; root is the smallest node.

    Each round every node takes the least of itself and its neighbours (order by a
    hash of the id, so that long chains shrink by a constant factor too), and the
    edges are rewritten to those representatives; rounds end when no edge is left.
    A round is one pre-aggregated ``min`` by node and two equi-joins, so a node
    with a third of all edges costs one row for each task, and join partitions of
    that node can be split.  Null ids and self links are ignored.  Every round's
    tables are staged in the shared folder.
    """
    spark = edges.sparkSession
    kind = edges.schema[u].dataType
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    live = staged(edges.select(key(u).alias("u"), key(v).alias("v")).where("u.id <> v.id")
                  .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    roots = None
    while not live.isEmpty():
        parent = staged(
            live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        if roots is None:
            roots = parent.select(F.col("u.id").alias("node"), F.col("p").alias("r"))
        else:
            roots = staged(roots.join(parent, roots.r == parent.u, "left")
                           .select("node", F.coalesce("p", "r").alias("r")), "roots")
        pu, pv = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        live = staged(live.join(pu, "u").join(pv, "v").where("pu <> pv")
                      .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if roots is None:
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    least = roots.groupBy("r").agg(F.min("node").alias("root"))
    return staged(roots.join(least, "r").select("node", "root"), "components")
