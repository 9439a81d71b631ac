"""Mergeable profiles of drops.

A drop (a day's files, a partition) is profiled once, in one aggregate without a
row per cell: counts, extremes, the sum, a HyperLogLog sketch of the distinct
values and a KLL sketch of the quantiles. The sketches are rows of a small table;
the profile of any set of drops is their merge, so a new drop costs its own size
and never a pass over what came before. ``stats.profile`` stays the exact one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch: standard error 0.8 %
LG_K = 14
QUANTILES = (0.25, 0.5, 0.75)


def sketch_drops(df: DataFrame, cols: list[str], drop: str | None = None) -> DataFrame:
    """(drop, column, n, nulls, total, min, max, distinct, quantiles): one row per
    drop (all rows, if None) and numeric column; the last two are sketches."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                  (F.col(drop).cast("string") if drop else F.lit("all")).alias("drop"))
    parts = [F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"),
        F.sum(c).alias("total"), F.min(c).alias("min"), F.max(c).alias("max"),
        # a distinct sketch takes no doubles: a hash of each, both zeros alike
        F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c) + F.lit(0.0))), LG_K).alias("distinct"),
        F.kll_sketch_agg_double(c).alias("quantiles")).alias(f"s{i}") for i, c in enumerate(cols)]
    wide = x.groupBy("drop").agg(*parts)
    return wide.select("drop", F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s")).select("drop", "s.*")


def merge_sketches(drops: DataFrame, by: str | None = None) -> DataFrame:
    """The drops' rows merged, one per column (and ``by``)."""
    return drops.groupBy("column", *([by] if by else [])).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("total").alias("total"), F.min("min").alias("min"),
        F.max("max").alias("max"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def profile_of(sketches: DataFrame, quantiles=QUANTILES) -> DataFrame:
    """Profile of merged sketches: n, nulls, mean, min, max, n_distinct (about)
    and the quantiles (about; null for a column without values)."""
    values = F.col("n") - F.col("nulls")
    q = {f"p{round(100 * p)}": F.when(values > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))) for p in quantiles}
    return sketches.select(
        "column", "n", "nulls", F.try_divide("total", values).alias("mean"), "min", "max",
        F.hll_sketch_estimate("distinct").alias("n_distinct"), *[e.alias(c) for c, e in q.items()])
