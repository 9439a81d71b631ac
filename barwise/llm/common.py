"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.session import ensure_checkpoint_dir

SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: rows of an Arrow batch of whole texts, at most
BATCH_ROWS = 256


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``: batches of
    10,000 whole texts take hundreds of MB of an executor outside its heap, and
    what the largest batch took stays with the workers and Arrow's buffers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: owner -> [stage that used it last, what it keeps between batches and tasks]
_KEPT: dict[str, list] = {}


def kept(owner: str, make: Callable[[], Any]) -> Any:
    """What ``owner`` keeps in this worker, made anew if it has nothing. What no
    operator of the running stage has used goes: Spark's workers outlive their
    stage, and each would come to hold the tables of every operator that it ran."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    mine = _KEPT.get(owner)
    if mine is None or mine[0] != stage:
        for k in [k for k, (last, _) in _KEPT.items() if last != stage and k != owner]:
            del _KEPT[k]
        mine = _KEPT[owner] = [stage, mine[1] if mine else make()]
    return mine[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_bytes(col) -> F.Column:
    """UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written in decimal; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer over uint64 (wraps around)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, with underscores in front where a column of ``df`` has the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of many ``rows`` a key with one of ``facts``, an aggregate on
    the same keys. The hash as one more key makes Spark exchange both sides for
    the join itself, instead of joining in the aggregate's partitioning; adaptive
    execution can then split partitions that a hot key fills."""
    k, = free_names(rows.select(*rows.columns, *[F.lit(0).alias(c) for c in facts.columns]), "__k")

    def tagged(df: DataFrame) -> DataFrame:
        return df.withColumn(k, F.xxhash64(*keys))

    return tagged(rows).join(tagged(facts), [*keys, k], how).drop(k)
