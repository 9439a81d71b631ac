"""Splits, scaling and folds.

Fitted statistics (means, deviations, cutoffs) are a handful of scalars per
column or per key: scalars are read back to the driver like any estimator fit;
per-key statistics are joined back on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.ordering import global_index


def _label(is_train):
    return F.when(is_train, F.lit("train")).otherwise(F.lit("test"))


def split_rows(df: DataFrame, frac: float = 0.8, order=("Ticker", "Date"), name="split"):
    """First floor(n * frac) rows in (Ticker, Date) order are train (the
    reference's "time" split, quirk Q7). Uses the distributed global index."""
    idx = global_index(df, list(order), name="_gi", total="_n")
    return idx.withColumn(name, _label(F.col("_gi") < F.floor(F.col("_n") * F.lit(frac)))) \
              .drop("_gi", "_n")


def split_per_key(df: DataFrame, frac: float = 0.8, key="Ticker", date="Date", name="split"):
    """Per key, the first floor(count * frac) bars are train."""
    w = Window.partitionBy(key).orderBy(date)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn(name, _label(F.row_number().over(w) <= F.floor(n * F.lit(frac))))


def time_cutoff(df: DataFrame, frac: float = 0.8, date="Date"):
    """The date at position floor(n_dates * frac) among the distinct dates."""
    dates = df.select(date).distinct()
    idx = global_index(dates, [date], name="_gi", total="_n")
    row = idx.filter(F.col("_gi") == F.floor(F.col("_n") * F.lit(frac))).select(date).first()
    return row[0] if row else None


def split_time(df: DataFrame, frac: float = 0.8, date="Date", name="split"):
    """Calendar split; every key's bars before the cutoff date are train."""
    cutoff = time_cutoff(df, frac, date)
    if cutoff is None:
        return df.withColumn(name, F.lit("train"))
    return df.withColumn(name, _label(F.col(date) < F.lit(cutoff)))


def zscore(df: DataFrame, cols: list[str], fit_on: str | None = "train", split="split",
           suffix: str = "") -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_on`` rows (None = all,
    which reproduces the reference's leakage, quirk Q8)."""
    fit = df.filter(F.col(split) == fit_on) if fit_on else df
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = fit.agg(*aggs).first().asDict()
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
    return df.withColumns(out)


def minmax(df: DataFrame, col: str, fit_on: str | None = "train", split="split", key="Ticker",
           name: str | None = None):
    """P5: per-key min-max scaling fitted on the train rows; keeps the fitted
    min and max columns for the inverse."""
    fit = df.filter(F.col(split) == fit_on) if fit_on else df
    st = fit.groupBy(key).agg(F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"))
    j = df.join(st, key)
    return j.withColumn(name or f"{col}_scaled", F.try_divide(
        F.col(col) - F.col(f"{col}_min"), F.col(f"{col}_max") - F.col(f"{col}_min")))


def minmax_inverse(df: DataFrame, scaled: str, col: str, name: str | None = None):
    lo, hi = F.col(f"{col}_min"), F.col(f"{col}_max")
    return df.withColumn(name or f"{scaled}_inv", F.col(scaled) * (hi - lo) + lo)


def rolling_folds(df: DataFrame, k: int = 4, key="Ticker", date="Date"):
    """Expanding-window folds. Bars are cut per key into k+1 date-ordered
    tiles; fold i trains on tiles <= i and tests on tile i+1. Returns one row
    per (bar, fold) where the bar takes part, with role train/test."""
    tile = F.ntile(k + 1).over(Window.partitionBy(key).orderBy(date))
    t = df.withColumn("tile", tile)
    fold = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    x = t.select("*", fold).filter(F.col("tile") <= F.col("fold") + 1)
    return x.withColumn("role", F.when(F.col("tile") <= F.col("fold"), "train").otherwise("test"))
