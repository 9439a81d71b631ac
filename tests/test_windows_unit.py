"""Hand-made series (nulls first / middle / last, one-row key, zero price,
constant series) checked against pandas' own rolling / shift / pct_change."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.operators import bars as B

D0 = dt.date(2024, 1, 1)


def _frame(spark):
    rows = []
    a = [10.0, 11.0, None, 12.5, 12.0, 13.0, 0.0, 14.0, 15.0, None, 16.0, 15.5]
    for i, c in enumerate(a):
        rows.append(("A", D0 + dt.timedelta(days=i), c))
    rows.append(("B", D0, 5.0))  # one-row key
    for i in range(8):  # constant series
        rows.append(("C", D0 + dt.timedelta(days=i), 7.0))
    return spark.createDataFrame(rows, "Ticker string, Date date, Close double")


def _pandas(spark_df):
    return spark_df.toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)


def _same(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    both_nan = np.isnan(a) & np.isnan(b)
    assert np.all(both_nan | np.isclose(a, b, rtol=1e-12, atol=1e-12)), (a, b)


@pytest.mark.parametrize("n,min_n", [(3, None), (5, 2), (4, 4)])
def test_rolling_mean_std_match_pandas(spark, n, min_n):
    df = _frame(spark).withColumns({
        "m": Wn.rolling_mean("Close", n, min_n), "s": Wn.rolling_std("Close", n, min_n)})
    p = _pandas(df)
    g = p.groupby("Ticker")["Close"]
    mp = min_n if min_n is not None else n
    _same(p["m"], g.transform(lambda x: x.rolling(n, min_periods=mp).mean()))
    _same(p["s"], g.transform(lambda x: x.rolling(n, min_periods=mp).std()))


def test_lags_pct_change_match_pandas(spark):
    df = Wn.lags(_frame(spark), "Close", (1, 2))
    df = Wn.pct_change(df, "Close", 2, "pc2")
    p = _pandas(df)
    g = p.groupby("Ticker")["Close"]
    _same(p["Lag_Close_1"], g.shift(1))
    _same(p["Lag_Close_2"], g.shift(2))
    expect = g.transform(lambda x: x / x.shift(2) - 1).replace([np.inf, -np.inf], np.nan)
    _same(p["pc2"], expect)  # zero denominator -> NULL instead of inf (quirk Q15)


def test_ffill_bfill_match_pandas(spark):
    df = B.fill_gaps(_frame(spark), cols=("Close",), volume="Volume")
    p = _pandas(df)
    raw = _pandas(_frame(spark))
    expect = raw.groupby("Ticker")["Close"].ffill()
    expect = expect.groupby(raw["Ticker"]).bfill()
    _same(p["Close"], expect)


def test_ffill_idempotent(spark):
    once = B.ffill(_frame(spark), ("Close",))
    twice = B.ffill(once, ("Close",))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_cumulative_return_and_drawdown(spark):
    df = B.fill_gaps(_frame(spark), cols=("Close",), volume="Volume")
    df = Wn.pct_change(df, "Close", 1, "Return")
    df = Wn.cumulative_return(df, "Return")
    df = Wn.drawdown(df, "Close")
    p = _pandas(df)
    for _t, g in p.groupby("Ticker"):
        r = g["Close"] / g["Close"].shift(1) - 1
        r = r.replace([np.inf, -np.inf], np.nan)
        _same(g["Cumulative_Return"], (1 + r).cumprod() - 1 if len(g) > 1 else [np.nan])
        dd = g["drawdown"].dropna()
        assert ((dd >= 0) & (dd <= 1)).all()


def test_price_position_in_unit_interval(spark):
    df = B.fill_gaps(_frame(spark), cols=("Close",), volume="Volume")
    p = _pandas(Wn.price_position(df, "Close", 3))
    v = p["Price_Position_20d"].dropna()
    assert ((v >= 0) & (v < 1)).all()


def test_targets_direction_and_last_bar(spark):
    df = B.fill_gaps(_frame(spark), cols=("Close",), volume="Volume")
    keep = _pandas(Wn.targets(df, "Close", drop_last=False))
    assert keep.groupby("Ticker").tail(1)["Target_Direction"].eq(0).all()
    dropped = Wn.targets(df, "Close").count()
    assert dropped == df.count() - 3  # one last bar per key


def test_sliding_windows_shape(spark):
    df = B.fill_gaps(_frame(spark), cols=("Close",), volume="Volume")
    rows = Wn.sliding_windows(df, "Close", 3).filter("Ticker = 'A'").orderBy("Date").collect()
    closes = [r.Close for r in _pandas(df).query("Ticker == 'A'").itertuples()]
    for i, r in enumerate(rows):
        assert list(r.x) == closes[i:i + 3] and r.y == closes[i + 3]


def test_calendar_flags(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 2, 29),), (dt.date(2024, 3, 31),)],
                              "Date date")
    r = Wn.calendar_cols(d).orderBy("Date").collect()
    assert [x.DayOfWeek for x in r] == [0, 3, 6]
    assert [x.Is_Month_End for x in r] == [0, 1, 1]
    assert [x.Is_Month_Start for x in r] == [1, 0, 0]


def test_dedup_keeps_first_in_source_order(spark):
    rows = [("A", D0, 1.0, 1), ("A", D0, 2.0, 0), ("A", D0 + dt.timedelta(days=1), 3.0, 0)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double, src int")
    out = sorted(B.dedup_bars(df, "src").collect())
    assert [r.Close for r in out] == [2.0, 3.0]


def test_ohlcv_bars_first_last(spark):
    rows = [("k", dt.datetime(2024, 1, 1, 9), 1, 10.0, 2.0), ("k", dt.datetime(2024, 1, 1, 12), 2, 12.0, 1.0),
            ("k", dt.datetime(2024, 1, 1, 10), 3, 8.0, 1.0), ("k", dt.datetime(2024, 1, 2, 9), 4, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, px double, q double")
    out = {r.Date: r for r in B.ohlcv_bars(df, "key", "ts", "px", "q", ["ts", "id"]).collect()}
    d1 = out[dt.date(2024, 1, 1)]
    assert (d1.Open, d1.High, d1.Low, d1.Close, d1.Volume) == (10.0, 12.0, 8.0, 12.0, 4.0)
    assert math.isclose(out[dt.date(2024, 1, 2)].Volume, 5.0)
