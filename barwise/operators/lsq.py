"""Per-key least squares as a Spark job (used by M1-M3, M10, M12, M13, M15, P6).

1. every task turns its rows into per-key Gram sums (n, X^T X, X^T y, y^T y) with
   numpy and emits one row per key (more only when its keys outgrow HELD_BYTES);
2. the sums of a key are added by an aggregate that combines map-side and holds
   one Gram row at a time, so a key in every task is no group of rows;
3. the k x k system of each key is solved from its summed Gram row.

Nothing but Gram rows (k^2 doubles per key) crosses the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_SCHEMA = "key string, n long, xtx array<double>, xty array<double>, yty double"
#: Gram sums that a task holds before it hands them on
HELD_BYTES = 64 << 20


def _partial(by, xcols, ycol):
    def frame(held):
        keys = [k if isinstance(k, tuple) else (k,) for k in held]
        return pd.DataFrame({**{c: [k[i] for k in keys] for i, c in enumerate(by)}, "v": list(held.values())})

    def fn(batches):
        held, size = {}, 0
        for pdf in batches:
            # rows with a missing value are skipped here, not by na.drop(): a
            # not-null filter over dozens of derived columns makes Catalyst's
            # constraint propagation blow up
            pdf = pdf.dropna()
            for k, g in pdf.groupby(by, sort=False):
                X = g[xcols].to_numpy(dtype="float64")
                y = g[ycol].to_numpy(dtype="float64")
                v = np.concatenate([[len(g)], (X.T @ X).ravel(), X.T @ y, [y @ y]])
                if k in held:
                    held[k] += v
                else:
                    held[k], size = v, size + v.nbytes
            if size > HELD_BYTES:
                yield frame(held)
                held, size = {}, 0
        if held:
            yield frame(held)
    return fn


def grouped_gram(df: DataFrame, key: str, xcols: list[str], ycol: str, part: str | None = None) -> DataFrame:
    """One row per key (and ``part``, an int column): n, X^T X (row-major), X^T y,
    y^T y over rows with no NULL."""
    by = ["key", "part"] if part else ["key"]
    x = df.select(F.col(key).cast("string").alias("key"), *([F.col(part).cast("int").alias("part")] if part else []),
                  *[F.col(c).cast("double").alias(c) for c in xcols],
                  F.col(ycol).cast("double").alias("_y"))
    kinds = ", ".join(f"{c} {t}" for c, t in zip(by, ("string", "int")))
    sums = (x.mapInPandas(_partial(by, xcols, "_y"), f"{kinds}, v array<double>")
            .groupBy(*by).agg(Summarizer.sum(array_to_vector("v")).alias("s")).withColumn("s", vector_to_array("s")))
    k = len(xcols)
    return sums.select(*by, F.round(F.col("s")[0]).cast("long").alias("n"), F.slice("s", 2, k * k).alias("xtx"),
                       F.slice("s", 2 + k * k, k).alias("xty"), F.element_at("s", -1).alias("yty"))


def solve_scaled(xtx: np.ndarray, xty: np.ndarray, yty: float, ridge: float = 0.0,
                 free: int = 0) -> tuple[np.ndarray, float]:
    """Coefficients and sum of squared residuals; columns are brought to length
    one first, and collinear ones share their effect (least norm). ``ridge`` is
    added for all columns but the first ``free``."""
    k = len(xty)
    a = xtx.reshape(k, k) + ridge * np.diag([0.0] * free + [1.0] * (k - free))
    s = np.sqrt(np.diag(a))
    s = np.where(s > 0, s, 1.0)
    beta = np.linalg.lstsq(a / np.outer(s, s), xty / s, rcond=1e-13)[0] / s
    return beta, max(float(yty - 2 * beta @ xty + beta @ xtx.reshape(k, k) @ beta), 0.0)


def aic(n: int, ssr: float, coefs: int) -> float:
    return n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * coefs


def solve(xtx: np.ndarray, xty: np.ndarray, yty: float, n: int, ridge: float = 0.0,
          penalize: np.ndarray | None = None):
    """OLS / ridge solution from Gram sums: beta, SSR, standard errors."""
    k = len(xty)
    A = xtx.reshape(k, k).copy()
    if ridge:
        pen = np.ones(k) if penalize is None else penalize
        A = A + ridge * np.diag(pen)
    beta = np.linalg.lstsq(A, xty, rcond=None)[0]
    ssr = float(yty - 2 * beta @ xty + beta @ xtx.reshape(k, k) @ beta)
    ssr = max(ssr, 0.0)
    dof = n - k
    se = np.full(k, np.nan)
    if dof > 0:
        try:
            inv = np.linalg.inv(A)
            se = np.sqrt(np.maximum(np.diag(inv) * ssr / dof, 0.0))
        except np.linalg.LinAlgError:
            pass
    return beta, ssr, se


#: Spark removes the shuffle files of an action that ended
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize_small(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Cut the lineage of a narrow model input or a fitted table.

    Model inputs are bar tables narrowed to (key, date, price) - far smaller
    than the facts they come from - and coefficient tables hold one row per
    key. The wide design plans built on top of them (dozens of derived
    columns) make Catalyst's constraint propagation explode when the join
    lineage of the bars is still below them. A reliable checkpoint (written to
    the cluster's ``spark.checkpoint.dir``) ends the plan there and also spares
    a recompute when an executor is lost. ``drop_shuffles``: the shuffle files of
    ``df`` go once it is written; else they stay until the driver collects garbage.
    """
    from barwise.session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not drop_shuffles:
        return df.checkpoint(eager=True)
    had = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if had is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, had)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out before an iterative fit, in partitions of the size that
    adaptive execution aims at: a small design costs one task a pass, a large one
    as many as it needs. Spark sorts before the round-robin shuffle, so a lost
    partition is recomputed with the same rows."""
    return df.hint("rebalance")
