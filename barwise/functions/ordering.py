"""Global row order without a single-task window (F27 global index, T2 ranks).

``Window.orderBy(...)`` without ``partitionBy`` moves every row into one task.
Instead we range-partition on the sort key (Spark samples the key to pick
balanced bounds), number rows inside each partition after a local sort, and
add the row count of all earlier partitions. The only data that is gathered is
one count per partition, which is bounded by the partition number and is the
only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _order_names(order):
    out = []
    for c in order:
        out.append(F.col(c) if isinstance(c, str) else c)
    return out


def global_index(df: DataFrame, order: list, name: str = "row_idx",
                 num_partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Append ``name``: the 0-based position of each row in ``order``.

    ``order`` must be a total order (add tie-break columns), otherwise equal
    rows are numbered in an arbitrary order, as in any SQL engine. ``total``
    names an optional column holding the row count of the whole frame.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols: list[Column] = _order_names(order)
    ranged = (df.repartitionByRange(n, *cols)
              .sortWithinPartitions(*cols)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright(F.col("_mid"), _LOW_BITS)) \
                   .withColumn("_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    # the range bounds come from a sample; if the exchange ran once for the
    # counts and once for the rows, the two could disagree. Writing the
    # numbered rows once (reliable checkpoint) makes both read the same rows.
    from barwise.operators.lsq import materialize_small
    ranged = materialize_small(ranged)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the single-partition window here is over <= n rows
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    out = (ranged.join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_off") + F.col("_local")))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_mid", "_pid", "_local", "_off", "_total")


def rank_by(df: DataFrame, metric: str, desc: bool = True, tie: list | None = None,
            name: str = "rank") -> DataFrame:
    """1-based rank of each row by ``metric`` (ties broken by ``tie``)."""
    m = F.col(metric).desc_nulls_last() if desc else F.col(metric).asc_nulls_last()
    order = [m] + [F.col(t).asc() for t in (tie or [])]
    out = global_index(df, order, name=name)
    return out.withColumn(name, (F.col(name) + F.lit(1)).cast("int"))
