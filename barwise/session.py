"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "barwise", driver_memory: str = "16g") -> SparkSession:
    """Session used by tests and the bench (local mode).

    On a cluster the submitter owns master, memory and the checkpoint folder;
    only the SQL settings below matter there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # shuffle partitions are sized at runtime by AQE towards this target,
        # skewed join partitions above the threshold are split
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "256m")
        .config("spark.sql.files.maxPartitionBytes", "128m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a local one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we read it from
    the session and never override it. Only when nothing is configured (local
    tests) do we pick a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="barwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def estimated_bytes(df) -> int:
    """Catalyst's size estimate of a DataFrame's optimized plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df, probe=None, limit: int | None = None):
    """Broadcast ``df`` only when the estimated size of ``probe`` (default
    ``df``) is within ``limit`` (default: the session's broadcast threshold);
    otherwise leave the join strategy to Catalyst / AQE (shuffle join)."""
    from pyspark.sql import functions as F
    spark = df.sparkSession
    if limit is None:
        raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
        limit = int(str(raw).lower().rstrip("b") or 0) if str(raw).lower().rstrip("b").lstrip("-").isdigit() \
            else 10 * 1024 * 1024
    if limit <= 0:
        return df
    size = estimated_bytes(probe if probe is not None else df)
    return F.broadcast(df) if size <= limit else df
