"""Cross-key statistics and reports.

All aggregates have a partial (map-side) stage, so a key holding a third of
the rows is combined before the shuffle; scalar ``max_by``/``min_by`` keep them
hash-based (a struct value or ordering key would force a sort aggregate). Statistics that need
a per-key window (drawdown, previous close) are computed in the same key
partitioning as the following aggregate: one Exchange serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.exprs import SQRT_252, col, ratio_minus_one
from barwise.functions.ordering import rank_by
from barwise.functions.windows import by_key, running


# ---------------------------------------------------------------- S7, A15, A16
def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: n, nulls, n_distinct, min, max, mean (numeric columns).

    The wide table is unpivoted to (column, value) so that a single distinct
    aggregate serves every column. Text, date and other columns: ``profile_text``.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count("value")).alias("nulls"),
        F.count_distinct("value").alias("n_distinct"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"))


def profile_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """S7 for key, date and text columns (any type, as text): n, nulls,
    n_distinct, first and last value in text order, longest value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("value")).alias("nulls"),
        F.count_distinct("value").alias("n_distinct"), F.min("value").alias("first_value"),
        F.max("value").alias("last_value"), F.max(F.length("value")).alias("max_length"))


def date_range(df: DataFrame, date="Date", key=None) -> DataFrame:
    """First and last date (per key when given)."""
    g = df.groupBy(key) if key else df.groupBy()
    return g.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


# ---------------------------------------------------------------- A1, A2
def total_return(df: DataFrame, price="adj_close", key="Ticker", date="Date",
                 with_rank: bool = True) -> DataFrame:
    """A1: (last / first - 1) * 100 per key, ranked from best."""
    out = df.groupBy(key).agg(
        ((F.try_divide(F.max_by(col(price), col(date)), F.min_by(col(price), col(date)))
          - F.lit(1.0)) * F.lit(100.0)).alias("total_return_pct"))
    return rank_by(out, "total_return_pct", desc=True, tie=[key]) if with_rank else out


def extremes(df: DataFrame, value: str, key="Ticker") -> DataFrame:
    """A2: best and worst key by ``value`` (ties to the smaller key), one row."""
    v = F.col(value)
    return df.agg(
        F.min_by(F.col(key), F.struct(-v, F.col(key))).alias("best"),
        F.max(v).alias("best_value"),
        F.min_by(F.col(key), F.struct(v, F.col(key))).alias("worst"),
        F.min(v).alias("worst_value"))


# ---------------------------------------------------------------- A3
def risk_stats(df: DataFrame, ret="Daily_Return", price="adj_close", key="Ticker",
               date="Date", percent: bool = False) -> DataFrame:
    """A3: annualised return (1+mean)^252-1, volatility std*sqrt(252),
    Sharpe mean/std*sqrt(252) and max drawdown, per key.

    ``percent=True`` reproduces the reference's scaling of every column by 100.
    """
    peak = F.max(col(price)).over(running(key, date))
    dd = df.withColumn("_dd", F.try_divide(peak - col(price), peak))
    m, s = F.avg(col(ret)), F.stddev_samp(col(ret))
    out = dd.groupBy(key).agg(
        (F.pow(F.lit(1.0) + m, F.lit(252.0)) - F.lit(1.0)).alias("ann_return"),
        (s * F.lit(SQRT_252)).alias("ann_volatility"),
        (F.try_divide(m, s) * F.lit(SQRT_252)).alias("sharpe"),
        F.max("_dd").alias("max_drawdown"))
    if percent:
        out = out.select(key, *[(F.col(c) * 100).alias(c) for c in out.columns if c != key])
    return out


# ---------------------------------------------------------------- A4, A5
def activity_stats(df: DataFrame, threshold: float = 0.05, ret="Daily_Return",
                   vol="Volatility_30d", volume="Volume", key="Ticker", date="Date"):
    """A4 + A5: mean volume in millions, mean volatility, % of days with
    |return| > threshold, number of trading days."""
    big = F.when(F.abs(col(ret)) > F.lit(threshold), F.lit(1.0)).otherwise(F.lit(0.0))
    return df.groupBy(key).agg(
        (F.avg(col(volume)) / F.lit(1e6)).alias("avg_volume_m"),
        F.avg(col(vol)).alias("avg_volatility_30d"),
        (F.avg(big) * F.lit(100.0)).alias("pct_big_move_days"),
        F.count_distinct(col(date)).alias("trading_days"))


# ---------------------------------------------------------------- A7
def extreme_pairs(corr: DataFrame, exclude_self: bool = True) -> DataFrame:
    """The most and least correlated pair (rows ``kind`` = strongest / weakest).

    Each unordered pair is taken once (a < b); with ``exclude_self=False`` the
    diagonal competes too, as in the reference.
    """
    c = corr.filter(F.col("corr").isNotNull())
    c = c.filter(F.col("ticker_a") < F.col("ticker_b")) if exclude_self else \
        c.filter(F.col("ticker_a") <= F.col("ticker_b"))
    rec = F.struct("ticker_a", "ticker_b", "corr")
    one = c.agg(
        F.min_by(rec, F.struct(-F.col("corr"), "ticker_a", "ticker_b")).alias("strongest"),
        F.min_by(rec, F.struct(F.col("corr"), "ticker_a", "ticker_b")).alias("weakest"))
    return one.select(F.explode(F.array(
        F.struct(F.lit("strongest").alias("kind"), F.col("strongest.*")),
        F.struct(F.lit("weakest").alias("kind"), F.col("weakest.*")))).alias("p")).select("p.*")


# ---------------------------------------------------------------- A8
def yearly_stats(df: DataFrame, ret="Daily_Return", close="Close", key="Ticker", date="Date"):
    """Per key and calendar year: mean and std of return, mean close."""
    return df.groupBy(key, F.year(col(date)).alias("Year")).agg(
        F.avg(col(ret)).alias("mean_return"),
        F.stddev_samp(col(ret)).alias("std_return"),
        F.avg(col(close)).alias("mean_close"))


# ---------------------------------------------------------------- A9, F25
def kpis(df: DataFrame, window_days: int | None = None, key="Ticker", date="Date") -> DataFrame:
    """Last close, change % vs the previous bar (0 with one bar), last volume,
    highest high and lowest low (over the last ``window_days`` days if given)."""
    w = by_key(key, date)
    x = df.withColumn("_prev", F.lag("Close", 1).over(w))
    if window_days is not None:
        last = F.max(col(date)).over(Window.partitionBy(key))
        inwin = col(date) > F.date_sub(last, window_days)
        x = x.withColumn("_hi", F.when(inwin, F.col("High"))).withColumn("_lo", F.when(inwin, F.col("Low")))
    else:
        x = x.withColumn("_hi", F.col("High")).withColumn("_lo", F.col("Low"))
    # one scalar max_by per column (dates are unique per key): hash aggregate
    out = x.groupBy(key).agg(F.max_by("Close", col(date)).alias("last_close"),
                             F.max_by("Volume", col(date)).alias("last_volume"),
                             F.max_by("_prev", col(date)).alias("_lp"),
                             F.max("_hi").alias("high_max"), F.min("_lo").alias("low_min"),
                             F.count(F.lit(1)).alias("n_bars"), F.max(col(date)).alias("last_date"))
    return out.select(
        key, "last_date", "last_close",
        F.coalesce(ratio_minus_one(F.col("last_close"), F.col("_lp")) * F.lit(100.0),
                   F.lit(0.0)).alias("change_pct"),
        "last_volume", "high_max", "low_min", "n_bars")


# ---------------------------------------------------------------- A10
def histogram(df: DataFrame, x: str, bins: int = 70, key="Ticker", scale: float = 1.0):
    """A10: equal-width histogram per key: (key, bin, lo, hi, n), empty bins kept.

    Per-key min/max is a small aggregate joined back on the key; counting is a
    partial aggregate on (key, bin).
    """
    v = col(x) * F.lit(scale)
    vals = df.select(key, v.alias("_v")).filter(F.col("_v").isNotNull())
    rng = vals.groupBy(key).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    rng = rng.withColumn("_w", (F.col("_max") - F.col("_min")) / F.lit(float(bins)))
    b = F.when(F.col("_w") > 0, F.least(F.floor((F.col("_v") - F.col("_min")) / F.col("_w")),
                                       F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = vals.join(rng, key).groupBy(key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(key, "_min", "_w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [key, "bin"], "left")
            .select(key, "bin",
                    (F.col("_min") + F.col("bin") * F.col("_w")).alias("lo"),
                    (F.col("_min") + (F.col("bin") + 1) * F.col("_w")).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- A11, A12
def label_counts(df: DataFrame, label: str, values: list, key="Ticker") -> DataFrame:
    """Key x label contingency table with zero fill (explicit pivot values,
    so Spark need not scan for the distinct labels first)."""
    return (df.groupBy(key).pivot(label, values).agg(F.count(F.lit(1)))
            .na.fill(0, [str(v) for v in values]))


def label_shares(df: DataFrame, label: str, key="Ticker") -> DataFrame:
    """Share of each label within its key (shares sum to 1 per key)."""
    c = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    return c.withColumn("share", F.col("n") / total)


# ---------------------------------------------------------------- A13, A14
def mean_of_daily_means(df: DataFrame, cols: list[str], date="Date") -> DataFrame:
    """Average by date first, then over dates (one row)."""
    daily = df.groupBy(date).agg(*[F.avg(c).alias(c) for c in cols])
    return daily.agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def zscore_flags(df: DataFrame, x: str, threshold: float = 3.0, key="Ticker", name="is_anomaly"):
    """Anomaly label |z| > threshold with the key's mean and sample std."""
    w = Window.partitionBy(key)
    z = F.try_divide(col(x) - F.avg(col(x)).over(w), F.stddev_samp(col(x)).over(w))
    return df.withColumn(name, F.coalesce(F.abs(z) > F.lit(threshold), F.lit(False)))


def anomaly_rate(df: DataFrame, flag="is_anomaly", key="Ticker") -> DataFrame:
    """Anomaly rate in % and count per key."""
    f = F.col(flag).cast("double")
    return df.groupBy(key).agg((F.avg(f) * F.lit(100.0)).alias("anomaly_rate_pct"),
                               F.count_if(F.col(flag)).alias("n_anomalies"))


def overall_anomaly_rate(df: DataFrame, flag="is_anomaly") -> DataFrame:
    """A14 over all keys: one row."""
    return df.agg((F.avg(F.col(flag).cast("double")) * F.lit(100.0)).alias("anomaly_rate_pct"),
                  F.count_if(F.col(flag)).alias("n_anomalies"), F.count(F.lit(1)).alias("n"))


def anomaly_calendar(df: DataFrame, keys: list[str], flag="is_anomaly", key="Ticker", date="Date") -> DataFrame:
    """A11 for anomalies: year-month x key counts of flagged rows, zero filled
    (explicit pivot keys; months without an anomaly have no row)."""
    return (df.filter(F.col(flag)).groupBy(F.date_format(date, "yyyy-MM").alias("YearMonth"))
            .pivot(key, keys).agg(F.count(F.lit(1))).na.fill(0, keys))


# ---------------------------------------------------------------- T3, T5
def top_abs(df: DataFrame, x: str, k: int = 10, tie=("Date", "Ticker")) -> DataFrame:
    """The k rows with the largest |x| (TakeOrderedAndProject: each task
    keeps its own top k, the driver merges k rows per task)."""
    return df.orderBy(F.abs(col(x)).desc_nulls_last(), *[F.col(t).asc() for t in tie]).limit(k)


def last_rows(df: DataFrame, n: int = 10, key="Ticker", date="Date") -> DataFrame:
    """T5: the last n bars of every key."""
    w = Window.partitionBy(key).orderBy(col(date).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def tail_rows(df: DataFrame, n: int = 10, order=("Date", "Ticker")) -> DataFrame:
    """T5 over the whole table: the last n rows (top n per task, then merged)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


# ---------------------------------------------------------------- J1
def with_fundamentals(df: DataFrame, dim: DataFrame, key="Ticker") -> DataFrame:
    """Left join of the fundamentals dimension with the reference's defaults:
    name '' and market cap 0 when absent, P/E 'N/A' when absent or 0."""
    j = df.join(dim, key, "left")
    pe = F.when(F.col("trailingPE").isNull() | (F.col("trailingPE") == 0), F.lit("N/A")) \
          .otherwise(F.format_string("%.2f", F.col("trailingPE")))
    return j.select(*df.columns,
                    F.coalesce(F.col("longName"), F.lit("")).alias("long_name"),
                    (F.coalesce(F.col("marketCap"), F.lit(0.0)) / F.lit(1e12)).alias("market_cap_t"),
                    pe.alias("pe_ratio"))
