"""Fills in one pass, metrics on complete pairs, samples and stopping rules,
tolerant readers, forecasts."""

import datetime as dt
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.operators import bars as B
from barwise.operators import metrics as Me
from barwise.operators import models as Mo
from barwise.operators import timeseries as Ts
from barwise.operators import unsupervised as U
from barwise.sources import files as Fi


def test_fill_of_a_long_key_is_linear(spark):
    n = 80_000
    df = spark.range(n).select(F.lit("K").alias("Ticker"), F.expr("date_add(date'1800-01-01', cast(id as int))").alias("Date"),
                               F.when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("Close"))
    df = df.cache()
    df.count()
    out = B.fill_gaps(df, ("Close",), volume=None)
    out.agg(F.sum("Close")).first()
    t = time.perf_counter()
    assert out.filter("Close is null").count() == 0
    both = B.bfill(df, ("Close",)).agg(F.count("Close")).first()[0]
    assert both == n
    assert time.perf_counter() - t < 20


def test_bfill_and_fill_gaps_agree_with_loops(spark):
    vals = [None, None, 3.0, None, 5.0, None]
    rows = [("A", dt.date(2024, 1, i + 1), v) for i, v in enumerate(vals)] + [("B", dt.date(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double")
    get = lambda d: [r.Close for r in d.orderBy("Ticker", "Date").collect()]
    assert get(B.bfill(df, ("Close",))) == [3.0, 3.0, 3.0, 5.0, 5.0, None, None]
    assert get(B.fill_gaps(df, ("Close",))) == [3.0, 3.0, 3.0, 3.0, 5.0, 5.0, None]


def test_metrics_skip_incomplete_pairs(spark):
    rows = [("m", 1.0, 1.5), ("m", 3.0, 2.0), ("m", 9.0, None), ("m", None, 4.0)]
    r = Me.regression_metrics(spark.createDataFrame(rows, "model string, actual double, predicted double")).first()
    e = np.array([0.5, -1.0])
    assert (r.n, r.n_skipped) == (2, 2)
    assert r.r2 == pytest.approx(1 - (e ** 2).sum() / 2.0) and r.mae == pytest.approx(0.75)


def test_quantize_passes_nan_and_large_values(spark):
    got = [r[0] for r in spark.createDataFrame([(1e13,), (math.nan,), (None,), (0.1,), (-1e300,)], "x double").select(quantize("x")).collect()]
    assert got[0] == 1e13 and math.isnan(got[1]) and got[2] is None and abs(got[3] - 0.1) < 1e-6 and got[4] == -1e300


@pytest.mark.parametrize("n", [300, 12_000])
def test_every_tree_gets_its_sample(spark, n):
    d = spark.range(n).select(F.lit("K").alias("Ticker"), F.expr("date_add(date'1900-01-01', cast(id as int))").alias("Date"),
                              F.rand(1).alias("x"))
    sizes = [r["count"] for r in U.tree_samples(d, ["x"], 20, min(256, n), n, 42).groupBy("tree").count().collect()]
    assert sizes == [min(256, n)] * 20


def test_isolation_finds_planted_outliers(spark):
    rng = np.random.default_rng(0)
    rows = [("K", dt.date(2000, 1, 1) + dt.timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    for i in (10, 500, 900):
        rows[i] = (*rows[i][:2], 9.0, -9.0)
    d = spark.createDataFrame(rows, "Ticker string, Date date, x double, y double")
    top = U.isolation_scores(d, ("x", "y"), trees=50).orderBy(F.col("anomaly_score").desc()).limit(3).collect()
    assert {r.Date for r in top} == {rows[i][1] for i in (10, 500, 900)}


def test_readers_take_missing_tokens(spark):
    path = Fi.scratch_path(spark, "t_tokens").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "b.csv"), "w") as f:
        f.write("Date,Ticker,Close,Volume\n2024-01-02,A,null,NA\nbad,A,x1,7\n2024-01-04,A,1.5,\n")
    rows = Fi.read_bars_csv(spark, path, flag_bad=True).orderBy("Volume", "Close").collect()
    assert sorted(((r.Date, r.Close, r.Volume, r._bad_cells) for r in rows), key=str) == sorted([
        (dt.date(2024, 1, 2), None, None, 0), (None, None, 7.0, 2), (dt.date(2024, 1, 4), 1.5, None, 0)], key=str)


def test_forecasts_against_numpy(spark):
    rng = np.random.default_rng(3)
    y = 50 + np.cumsum(rng.normal(size=300))
    rows = [("K", dt.date(2023, 1, 2) + dt.timedelta(i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, Close double")
    p, lo, hi, back = 2, y.min(), y.max(), 5
    d = np.diff(y)
    x = np.array([[1, d[i - 1], d[i - 2]] for i in range(p, len(d))])
    c = np.linalg.lstsq(x, d[p:], rcond=None)[0]
    lag, level, want = [d[-1], d[-2]], y[-1], []
    for _ in range(8):
        nxt = c[0] + c[1] * lag[0] + c[2] * lag[1]
        lag, level = [nxt, lag[0]], level + nxt
        want.append(level)
    got = [r.yhat for r in Ts.ar_future(df, 8, p).orderBy("Date").collect()]
    assert got == pytest.approx(want)
    s = (y - lo) / (hi - lo)
    x = np.array([np.append(1, s[i - back:i][::-1]) for i in range(back, len(s))])
    pen = np.diag([0.0] + [1e-3] * back)
    c = np.linalg.solve(x.T @ x + pen, x.T @ s[back:])
    w, want = list(s[-back:][::-1]), []
    for _ in range(8):
        nxt = c[0] + c[1:] @ np.array(w)
        w = [nxt] + w[:-1]
        want.append(nxt * (hi - lo) + lo)
    got = [r.yhat for r in Ts.window_regressor_forecast(df, 8, back).orderBy("Date").collect()]
    assert got == pytest.approx(want)


def test_window_backtest_is_one_step_ahead(spark):
    rng = np.random.default_rng(5)
    y = 20 + np.cumsum(rng.normal(size=200))
    df = spark.createDataFrame([("K", dt.date(2023, 1, 2) + dt.timedelta(i), float(v)) for i, v in enumerate(y)],
                               "Ticker string, Date date, Close double")
    n, back = 160, 4
    lo, hi = y[:n].min(), y[:n].max()
    s = (y - lo) / (hi - lo)
    x = np.array([np.append(1, s[i - back:i][::-1]) for i in range(back, 200)])
    pen = np.diag([0.0] + [1e-3] * back)
    c = np.linalg.solve(x[:n - back].T @ x[:n - back] + pen, x[:n - back].T @ s[back:n])
    want = (x[n - back:] @ c) * (hi - lo) + lo
    got = [r.predicted for r in Ts.window_regressor_backtest(df, back).orderBy("Date").collect()]
    assert got == pytest.approx(list(want))


def test_holiday_terms_are_learned(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(800)]
    y = [100.0 + (20.0 if d.day == 15 else 0.0) for d in days]
    df = spark.createDataFrame([("K", d, v) for d, v in zip(days, y)], "Ticker string, Date date, Close double")
    holidays = spark.createDataFrame([("mid", d) for d in days if d.day == 15], "holiday string, Date date")
    got = Ts.seasonal_backtest(df, seasons=Ts.RESEARCH_SEASONS, holidays=holidays).collect()
    assert max(abs(r.actual - r.predicted) for r in got) < 2.0
    plain = Ts.seasonal_backtest(df, seasons=Ts.RESEARCH_SEASONS).collect()
    assert max(abs(r.actual - r.predicted) for r in plain) > 10.0
