"""Per-key, date-ordered window features.

Every function takes the key and date column names and adds columns. All
frames share one ``Window.partitionBy(key).orderBy(date)``, so when several are
chained Catalyst plans a single Exchange + Sort for all of them.

Scale: the window input is a bar table, one row per (key, date). A key holds at
most one row per calendar day, so a window task is bounded by the length of the
calendar, whatever the size of the raw facts the bars were built from.

"Full" windows follow pandas ``rolling(n)``: NULL until the frame holds ``n``
non-NULL values (``min_n`` overrides the count).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.exprs import (SQRT_252, col, hl_range, intraday_return,
                                     month_end_flag, month_start_flag,
                                     ratio_minus_one, safe_ratio, typical_price,
                                     weekday_mon0)


def by_key(key="Ticker", date="Date"):
    return Window.partitionBy(key).orderBy(date)


def trailing(n: int, key="Ticker", date="Date"):
    """Frame of the current row and the n-1 rows before it."""
    return by_key(key, date).rowsBetween(-(n - 1), 0)


def running(key="Ticker", date="Date"):
    return by_key(key, date).rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg, x, n: int, min_n: int | None = None, key="Ticker", date="Date") -> Column:
    """agg(x) over the last n rows, NULL until min_n (default n) non-NULL values."""
    w = trailing(n, key, date)
    need = n if min_n is None else min_n
    return F.when(F.count(col(x)).over(w) >= need, agg(col(x)).over(w))


def rolling_mean(x, n, min_n=None, key="Ticker", date="Date") -> Column:
    return rolling(F.avg, x, n, min_n, key, date)


def rolling_std(x, n, min_n=None, key="Ticker", date="Date") -> Column:
    return rolling(F.stddev_samp, x, n, min_n, key, date)


def _pieces(n: int) -> list[tuple[int, int]]:
    """(width, offset) of runs of 1, 4, 16, ... rows that make up the last n rows."""
    out, at = [], 0
    while at < n:
        width = 4 ** int(math.log(n - at, 4) + 1e-9)
        out.append((width, at))
        at += width
    return out


def add_rolling(df: DataFrame, frames: dict[str, tuple[str, str, int]], key="Ticker", date="Date") -> DataFrame:
    """Adds full rolling means, minima and maxima, ``frames`` = {name: ("mean" |
    "min" | "max", column, rows)}; values as ``rolling``'s but for the last digit.

    A trailing frame is aggregated anew at every row, so a frame of 200 rows costs
    200 steps a row. Here runs of 4, 16, 64 ... rows are built from four runs of the
    size below, by lags, and a frame is put together from a few runs. Nothing
    outside a frame enters it, so no digits cancel; what a frame holds is counted by
    the difference of two running counts."""
    w = by_key(key, date)
    join = {"mean": lambda vs: reduce(lambda a, b: a + b, vs), "min": lambda vs: F.least(*vs), "max": lambda vs: F.greatest(*vs)}
    kinds = {(kind, x): f"_{kind}_{x}_" for kind, x, _ in frames.values()}
    most = {kx: max(n for kind, x, n in frames.values() if (kind, x) == kx) for kx in kinds}

    def lagged(kind, c, k):
        return F.lag(c, k, 0.0 if kind == "mean" else None).over(w) if k else F.col(c)

    out = df.withColumns({**{f"{p}1": F.coalesce(col(x).cast("double"), F.lit(0.0)) if kind == "mean" else col(x) for (kind, x), p in kinds.items()},
                          **{f"_count_{x}": F.count(col(x)).over(running(key, date)) for _, x in kinds}})
    width = 1
    while any(4 * width <= n for n in most.values()):
        out = out.withColumns({f"{p}{4 * width}": join[kx[0]]([lagged(kx[0], f"{p}{width}", k * width) for k in range(4)])
                               for kx, p in kinds.items() if 4 * width <= most[kx]})
        width *= 4
    cols = {}
    for name, (kind, x, n) in frames.items():
        parts = [lagged(kind, f"{kinds[kind, x]}{size}", at) for size, at in _pieces(n)]
        held = F.col(f"_count_{x}") - F.lag(f"_count_{x}", n, 0).over(w)
        value = join[kind](parts) if len(parts) > 1 else parts[0]
        cols[name] = F.when(held >= n, F.try_divide(value, held) if kind == "mean" else value)
    return out.withColumns(cols).drop(*[c for c in out.columns if c not in df.columns])


# ---------------------------------------------------------------- F1-F3
def calendar_cols(df: DataFrame, date="Date") -> DataFrame:
    """Year, Month, Day, DayOfWeek (Mon=0), Is_Month_End, Is_Month_Start."""
    d = F.col(date)
    return df.withColumns({
        "Year": F.year(d), "Month": F.month(d), "Day": F.dayofmonth(d),
        "DayOfWeek": weekday_mon0(d),
        "Is_Month_End": month_end_flag(d), "Is_Month_Start": month_start_flag(d),
    })


# ---------------------------------------------------------------- F10-F12
def sma(df: DataFrame, x="Close", n=7, name=None, key="Ticker", date="Date") -> DataFrame:
    """simple moving average over n rows (full)."""
    return df.withColumn(name or f"MA{n}", rolling_mean(x, n, key=key, date=date))


def rolling_std_col(df, x="Daily_Return", n=30, min_n=10, name="Volatility_30d",
                    key="Ticker", date="Date") -> DataFrame:
    """sample std over n rows with min_n values (research volatility)."""
    return df.withColumn(name, rolling_std(x, n, min_n, key, date))


def annualized_vol(df, x="Return", n=30, name="Volatility_30d", key="Ticker", date="Date"):
    """full n-row sample std x sqrt(252) (dashboard volatility)."""
    return df.withColumn(name, rolling_std(x, n, None, key, date) * F.lit(SQRT_252))


# ---------------------------------------------------------------- F13-F17, F26
def lags(df, x="Close", ks=(1, 2, 3, 5), prefix="Lag_Close_", key="Ticker", date="Date"):
    """lagged copies of x."""
    w = by_key(key, date)
    return df.withColumns({f"{prefix}{k}": F.lag(col(x), k).over(w) for k in ks})


def lag_matrix(df, x="Close", n=20, target="target", key="Ticker", date="Date", drop=True):
    """lag_1..lag_n and the current value as target; incomplete rows dropped."""
    out = lags(df, x, range(1, n + 1), "lag_", key, date).withColumn(target, col(x))
    return out.na.drop(subset=[f"lag_{k}" for k in range(1, n + 1)] + [target]) if drop else out


def pct_change(df, x="Close", n=1, name=None, key="Ticker", date="Date"):
    """X / lag(x, n) - 1."""
    w = by_key(key, date)
    return df.withColumn(name or f"{x}_pct_{n}", ratio_minus_one(col(x), F.lag(col(x), n).over(w)))


def overnight_gap(df, gap="open_open", name="Overnight_Gap", key="Ticker", date="Date"):
    """open-to-open change (the reference's definition) or close-to-open."""
    w = by_key(key, date)
    prev = F.lag("Open", 1).over(w) if gap == "open_open" else F.lag("Close", 1).over(w)
    return df.withColumn(name, ratio_minus_one(F.col("Open"), prev))


def diff(df, x="Close", name=None, key="Ticker", date="Date"):
    """first difference."""
    return df.withColumn(name or f"{x}_diff", col(x) - F.lag(col(x), 1).over(by_key(key, date)))


def log_return(df, x="adj_close", name="log_return", key="Ticker", date="Date"):
    """ln(p / p_prev); NULL for a missing or non-positive ratio."""
    r = F.try_divide(col(x), F.lag(col(x), 1).over(by_key(key, date)))
    return df.withColumn(name, F.when(r > 0, F.ln(r)))


# ---------------------------------------------------------------- F18-F20
def price_position(df, x="Close", n=20, name="Price_Position_20d", key="Ticker", date="Date"):
    """(x - min) / (max - min + 1e-8) over n rows (full)."""
    lo = rolling(F.min, x, n, key=key, date=date)
    hi = rolling(F.max, x, n, key=key, date=date)
    return df.withColumn(name, safe_ratio(col(x) - lo, hi - lo, 1e-8))


def volume_features(df, v="Volume", n=20, key="Ticker", date="Date"):
    """Volume_MA20 (full) and Volume / (Volume_MA20 + 1e-6)."""
    ma = f"Volume_MA{n}"
    out = df.withColumn(ma, rolling_mean(v, n, key=key, date=date))
    return out.withColumn("Volume_Ratio", safe_ratio(col(v), F.col(ma), 1e-6))


def targets(df, price="adj_close", key="Ticker", date="Date", drop_last=True):
    """next price and direction flag (1 if the next price is higher).

    ``drop_last`` drops the last bar per key (the ML frame); otherwise the
    comparison with a missing next value gives 0, as in the panel.
    """
    nxt = F.lead(col(price), 1).over(by_key(key, date))
    out = df.withColumn("Target_Next_Price", nxt)
    out = out.withColumn("Target_Direction",
                         F.coalesce(F.col("Target_Next_Price") > col(price), F.lit(False)).cast("int"))
    return out.filter(F.col("Target_Next_Price").isNotNull()) if drop_last else out


# ---------------------------------------------------------------- F22-F25, F27
def cumulative_return(df, r="Return", name="Cumulative_Return", key="Ticker", date="Date"):
    """running product of (1 + r) - 1; NULL where r is missing (the product
    carries on past it, like pandas' cumprod)."""
    prod = F.product(F.lit(1.0) + col(r)).over(running(key, date)) - F.lit(1.0)
    return df.withColumn(name, F.when(col(r).isNotNull(), prod))


def drawdown(df, x="adj_close", name="drawdown", key="Ticker", date="Date"):
    """(running max - x) / running max."""
    peak = F.max(col(x)).over(running(key, date))
    return df.withColumn(name, F.try_divide(peak - col(x), peak))


def sliding_windows(df, x="Close", steps=60, key="Ticker", date="Date", name="x", target="y"):
    """x = the previous ``steps`` values (oldest first), y = current value.

    Rows without a complete lookback are dropped.
    """
    w = by_key(key, date).rowsBetween(-steps, -1)
    out = df.withColumn(name, F.collect_list(col(x)).over(w)).withColumn(target, col(x))
    return out.filter(F.size(F.col(name)) == steps)


def with_row_index(df, key="Ticker", date="Date", name="row_in_key"):
    """1-based row number per key in date order."""
    return df.withColumn(name, F.row_number().over(by_key(key, date)))


# ---------------------------------------------------------------- composites
def features(df: DataFrame, key="Ticker", date="Date") -> DataFrame:
    """The research panel: 24 engineered columns in one window pass."""
    w = by_key(key, date)
    out = calendar_cols(df, date).withColumn("Daily_Return", intraday_return())
    out = add_rolling(out, {"MA7": ("mean", "Close", 7), "MA30": ("mean", "Close", 30), "MA90": ("mean", "Close", 90),
                            "Volume_MA20": ("mean", "Volume", 20), "_lo20": ("min", "Close", 20), "_hi20": ("max", "Close", 20)}, key, date)
    lo20, hi20 = F.col("_lo20"), F.col("_hi20")
    out = out.withColumns({
        "Volatility_30d": rolling_std("Daily_Return", 30, 10, key, date),
        "Lag_Close_1": F.lag("Close", 1).over(w),
        "Lag_Close_2": F.lag("Close", 2).over(w),
        "Lag_Close_3": F.lag("Close", 3).over(w),
        "Lag_Close_5": F.lag("Close", 5).over(w),
        "Momentum_5d": ratio_minus_one(F.col("Close"), F.lag("Close", 5).over(w)),
        "Momentum_10d": ratio_minus_one(F.col("Close"), F.lag("Close", 10).over(w)),
        "Price_Position_20d": safe_ratio(F.col("Close") - lo20, hi20 - lo20, 1e-8),
        "HL_Range": hl_range(),
        "Typical_Price": typical_price(),
        "Overnight_Gap": ratio_minus_one(F.col("Open"), F.lag("Open", 1).over(w)),
        "Target_Direction": F.coalesce(F.lead("Close", 1).over(w) > F.col("Close"),
                                       F.lit(False)).cast("int"),
    })
    out = out.withColumn("Volume_Ratio", safe_ratio(F.col("Volume"), F.col("Volume_MA20"), 1e-6))
    base = [c for c in df.columns]
    from barwise.schema import FEATURE_COLS
    return out.select(*base, *FEATURE_COLS)


def indicators(df: DataFrame, key="Ticker", date="Date") -> DataFrame:
    """Dashboard columns: SMA_50, SMA_200, Return, Volatility_30d, Cumulative_Return."""
    w = by_key(key, date)
    out = add_rolling(df, {"SMA_50": ("mean", "Close", 50), "SMA_200": ("mean", "Close", 200)}, key, date)
    out = out.withColumn("Return", ratio_minus_one(F.col("Close"), F.lag("Close", 1).over(w)))
    out = annualized_vol(out, "Return", 30, "Volatility_30d", key, date)
    return cumulative_return(out, "Return", "Cumulative_Return", key, date)
