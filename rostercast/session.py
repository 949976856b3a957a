"""Session helpers.

The library never creates a cluster session on its own: every operator takes the
caller's ``SparkSession`` (or a DataFrame).  ``local_session`` exists for tests,
the bench and the smoke entry point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "rostercast") -> SparkSession:
    """A local session tuned for small-scale correctness runs (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ROSTERCAST_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share (``spark.checkpoint.dir``).

    On a cluster the setting must be present: a machine-local folder would not be
    seen by the executors, so a missing setting raises.  Only a ``local`` master,
    where driver and executors are one process, gets a scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and all executors")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rostercast-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Register :func:`shared_dir` with the SparkContext unless it has a checkpoint folder already."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = shared_dir(spark)
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss).

    Used before loops that reuse one frame many times (grid search, learning
    curves).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def right_sized(df: DataFrame, rows_each: int = 20_000) -> DataFrame:
    """``df`` materialised in partitions of about ``rows_each`` rows.

    A layout for iterative fits: every tree level runs a task for each partition, so
    a few thousand daily rows must not keep the partition count of the shuffle that
    made them.  Large frames keep their partitions.
    """
    kept = cut_lineage(df)
    n = max(1, -(-kept.count() // rows_each))
    return kept.coalesce(n) if n < kept.rdd.getNumPartitions() else kept
