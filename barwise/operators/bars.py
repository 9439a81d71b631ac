"""Bars: building (S8), history window (S3), source fallback (S4), cleaning.

Shuffle budget of ``clean_bars``: one Exchange on (key, date) for the dedup
and one on key for the fills; the fills and any following feature windows share
the key partitioning.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.exprs import col
from barwise.schema import OHLCV


# ---------------------------------------------------------------- S8
def ohlcv_bars(df: DataFrame, key, ts, price, volume=None, order=None, adj=None,
               key_name: str = "Ticker", date_name: str = "Date", of_order: bool = False) -> DataFrame:
    """Resample ticks / trades into daily OHLCV bars.

    ``order`` lists the columns that order rows inside a day (first row = Open,
    last row = Close); it should be a total order. ``adj`` is an optional
    per-row expression whose value on the last row becomes ``adj_close``
    (defaults to the close). ``volume`` defaults to the number of ticks.
    ``of_order``: ``price`` and ``adj`` are functions of a lookup of the ``order``
    columns; the shuffle then carries the first and the last order key of a bar and
    no copy of it for every price taken there.

    All aggregates (min_by/max_by over a struct key, min, max, sum) are
    partial-aggregatable, so a hot key is combined map-side before the shuffle:
    the shuffle carries at most one row per (key, day) per input partition.
    The struct ordering key makes Spark pick a sort-based aggregate (a struct
    cannot live in a hash-aggregate buffer); it is kept because it gives an
    exact, total first/last order.
    """
    order = order or [ts]
    ordk = F.struct(*[col(c) for c in order])
    adj = price if adj is None else adj
    px, adj_c = (c(F.col) if of_order else col(c) for c in (price, adj))
    vol = F.sum(col(volume)).cast("double") if volume is not None else F.count(F.lit(1)).cast("double")
    # group on the raw key (a bigint sorts faster than its text) and cast after
    bars = df.groupBy(col(key).alias("_k"), F.to_date(col(ts)).alias(date_name))
    spread = F.max(px).alias("High"), F.min(px).alias("Low"), vol.alias("Volume")
    if of_order:
        agg = bars.agg(F.min(ordk).alias("_first"), F.max(ordk).alias("_last"), *spread)
        first, last = (lambda c, row=row: F.col(f"{row}.{c}") for row in ("_first", "_last"))
        agg = agg.withColumns({"Open": price(first), "Close": price(last), "adj_close": adj(last)})
    else:
        agg = bars.agg(F.min_by(px, ordk).alias("Open"), F.max_by(px, ordk).alias("Close"),
                       F.max_by(adj_c, ordk).alias("adj_close"), *spread)
    return agg.select(F.col("_k").cast("string").alias(key_name), date_name, "Open", "High", "Low",
                      "Close", "adj_close", "Volume")


# ---------------------------------------------------------------- S3, S4
def trailing_history(df: DataFrame, days: int, key="Ticker", date="Date") -> DataFrame:
    """Keep the bars of the last ``days`` days before each key's latest bar.

    The per-key max is a window over the key partition, so the filter reuses the
    partitioning that later feature windows need.
    """
    last = F.max(col(date)).over(Window.partitionBy(key))
    return (df.withColumn("_last", last)
            .filter(col(date) > F.date_sub(F.col("_last"), days)).drop("_last"))


def prefer_source(primary: DataFrame, secondary: DataFrame, keys=("Ticker",),
                  tag: str | None = "source") -> DataFrame:
    """Per key: the primary source's rows; the secondary's only for keys the
    primary lacks. The anti join probes the (small) distinct key list."""
    keys = list(keys)
    have = primary.select(*keys).distinct()
    fallback = secondary.join(have, keys, "left_anti")
    if tag:
        primary = primary.withColumn(tag, F.lit("primary"))
        fallback = fallback.withColumn(tag, F.lit("secondary"))
    return primary.unionByName(fallback)


# ---------------------------------------------------------------- C1
def normalize_name(name: str) -> str:
    """Strip, spaces to underscores, 'Adj Close' to snake case."""
    n = re.sub(r"\s+", "_", name.strip())
    return "adj_close" if n.lower() == "adj_close" else n


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


# ---------------------------------------------------------------- C3-C8
def dedup_bars(df: DataFrame, order_col, key="Ticker", date="Date") -> DataFrame:
    """One row per (key, date), the first in ``order_col`` order.

    Not ``dropDuplicates``, which keeps an arbitrary row.
    """
    order = order_col if isinstance(order_col, (list, tuple)) else [order_col]
    w = Window.partitionBy(key, date).orderBy(*[col(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def drop_missing_keys(df: DataFrame, cols=("Date", "Ticker")) -> DataFrame:
    """C4."""
    return df.na.drop(subset=list(cols))


def ffill(df: DataFrame, cols=tuple(OHLCV), key="Ticker", date="Date") -> DataFrame:
    """Carry the last non-NULL value forward within a key."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})


def bfill(df: DataFrame, cols=tuple(OHLCV), key="Ticker", date="Date") -> DataFrame:
    """Fill what is still missing from the next non-NULL value in the key.

    A running frame over descending dates: one pass per key (a frame that ends
    at the partition's end is evaluated anew for every row)."""
    w = Window.partitionBy(key).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(w) for c in cols})


def fill_const(df: DataFrame, values: dict) -> DataFrame:
    """C7."""
    return df.na.fill(values)


def drop_incomplete(df: DataFrame, subset=None) -> DataFrame:
    """Drop every row holding a NULL (removes the window warm-up rows)."""
    return df.na.drop("any", subset=subset)


def fill_gaps(df: DataFrame, cols=tuple(OHLCV), key="Ticker", date="Date",
              volume="Volume") -> DataFrame:
    """C5 -> C6 -> C7 (volume still missing becomes 0).

    After the forward fill only a key's leading gap is left, which takes the
    key's first non-NULL value: both frames share one sort and one pass."""
    w = Window.partitionBy(key).orderBy(date)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({c: F.coalesce(F.last(F.col(c), ignorenulls=True).over(past),
                                        F.first(F.col(c), ignorenulls=True).over(whole)) for c in cols})
    return fill_const(out, {volume: 0.0}) if volume in cols else out


def clean_bars(df: DataFrame, order_col: str = "src", key="Ticker", date="Date",
               cols=tuple(OHLCV)) -> DataFrame:
    """C12 = C3 -> C4 -> C5 -> C6 -> C7 (C1/C2 belong to the readers)."""
    out = dedup_bars(df, order_col, key, date)
    out = drop_missing_keys(out, (date, key))
    return fill_gaps(out, cols, key, date)


def in_universe(df: DataFrame, universe: DataFrame, group: str, key="Ticker") -> DataFrame:
    """Keep the keys of one universe group (semi join).

    The universe is a dimension of a few rows per group; Catalyst broadcasts it
    when its statistics are below the broadcast threshold.
    """
    members = universe.filter(F.col("group") == group).select(key)
    return df.join(members, key, "left_semi")
