"""Seasonal ARMA by two regressions, and rolling refits, against numpy."""

import datetime as dt

import numpy as np
import pytest

from barwise.operators.arma import arma_forecast, fit_arma, lag_sets
from barwise.operators.lsq import grouped_gram
from barwise.operators.rolling import rolling_refits


def lagged(x, j):
    return np.concatenate([np.full(j, np.nan), x[:len(x) - j]])


def brute(y, order, most, season, long_ar):
    """(n, beta, ssr, innovations) of the two regressions on plain arrays."""
    x = np.column_stack([np.ones(len(y)), *[lagged(y, j) for j in range(1, long_ar + 1)]])
    ok = ~np.isnan(x).any(axis=1)
    e = np.full(len(y), np.nan)
    e[ok] = y[ok] - x[ok] @ np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
    ar, ma = lag_sets(order, season)
    z = np.column_stack([np.ones(len(y)), *[lagged(y, j) for j in ar], *[lagged(e, j) for j in ma]])
    ok = ~np.isnan(lagged(e, most))
    beta = np.linalg.lstsq(z[ok], y[ok], rcond=None)[0]
    return int(ok.sum()), beta, float(((y[ok] - z[ok] @ beta) ** 2).sum()), e


@pytest.fixture(scope="module")
def series():
    rng, out = np.random.default_rng(4), {}
    for key, n in (("a", 600), ("b", 400)):
        e = rng.normal(size=n + 50)
        y = np.zeros(n + 50)
        for t in range(10, n + 50):
            y[t] = 2 + 0.5 * y[t - 1] - 0.3 * y[t - 5] + e[t] + 0.4 * e[t - 1]
        out[key] = y[50:]
    return out


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "Ticker string, Date date, value double").persist()


def test_orders_and_coefficients(frame, series):
    limits, season, long_ar, most = (2, 1, 1, 1), 5, 12, 5
    got = fit_arma(frame, limits, season, long_ar).collect()
    assert len(got) == 2 * 3 * 2 * 2 * 2
    for r in got:
        n, beta, ssr, _ = brute(series[r.Ticker], (r.p, r.q, r.sp, r.sq), most, season, long_ar)
        assert r.n == n and abs(r.sigma2 - ssr / n) < 1e-9
        assert np.allclose([r.const, *r.phi, *r.theta], beta, atol=1e-8)
    for key in series:
        own = [r for r in got if r.Ticker == key]
        best = next(r for r in own if r.is_best)
        assert best.aic == min(r.aic for r in own) and best.p >= 1 and best.sp == 1


def test_forecast(frame, series):
    limits, season, long_ar, most = (1, 1, 1, 0), 5, 10, 5
    got = arma_forecast(frame, 8, limits, season, long_ar, search=False)
    got = {(r.Ticker, r.step): r.yhat for r in got.collect()}
    for key, y in series.items():
        _, beta, _, e = brute(y, limits, most, season, long_ar)
        ys, es = list(y), list(e)
        for step in range(1, 9):
            ys.append(beta[0] + beta[1] * ys[-1] + beta[2] * ys[-5] + beta[3] * es[-1])
            es.append(0.0)
            assert abs(got[key, step] - ys[-1]) < 1e-7


def test_chunks_change_nothing(frame):
    def rows(df):
        return sorted((r.Ticker, r.p, r.q, r.sp, r.sq, r.n, round(r.aic, 6)) for r in df.collect())
    assert rows(fit_arma(frame, (1, 1, 1, 1))) == rows(fit_arma(frame, (1, 1, 1, 1), chunk_rows=70))


def test_gram_of_a_key_in_many_tasks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3))
    df = spark.createDataFrame([("k", *map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0), ("k", None, 1.0, 1.0)],
                               "key string, a double, b double, y double").repartition(9)
    r = grouped_gram(df, "key", ["a", "b"], "y").collect()
    assert len(r) == 1 and r[0].n == 5000
    assert np.allclose(np.reshape(r[0].xtx, (2, 2)), x[:, :2].T @ x[:, :2]) and np.allclose(r[0].xty, x[:, :2].T @ x[:, 2])
    assert np.isclose(r[0].yty, x[:, 2] @ x[:, 2])


@pytest.mark.parametrize("ridge", [0.0, 1.0])
def test_rolling_refits_equal_separate_fits(spark, ridge):
    rng, rows, want = np.random.default_rng(2), [], {}
    names = [f"f{i}" for i in range(27)]
    for key, n in (("a", 303), ("b", 250)):
        x = rng.normal(size=(n, 27)) * rng.uniform(0.1, 50, 27) + rng.uniform(-100, 100, 27)
        x[:, 26] = x[:, 0] - x[:, 1]  # collinear
        y = x @ rng.normal(size=27) * 0.1 + rng.normal(size=n)
        rows += [(key, dt.date(2000, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(n)]
        big = n % 5
        ends = np.cumsum([n // 5 + (i < big) for i in range(5)])
        for fold in range(1, 5):
            train, test = slice(0, ends[fold - 1]), slice(ends[fold - 1], ends[fold])
            m, s = x[train].mean(axis=0), x[train].std(axis=0)
            z = (x - m) / s
            a, b = z[train].T @ z[train] + ridge * np.eye(27), z[train].T @ (y[train] - y[train].mean())
            beta = np.linalg.lstsq(a, b, rcond=1e-10)[0]
            for i in range(test.start, test.stop):
                want[key, fold, i] = z[i] @ beta + y[train].mean()
    rows.append(("a", dt.date(2020, 1, 1), *[None] * 27, 1.0))
    df = spark.createDataFrame(rows, "Ticker string, Date date, " + ", ".join(f"{c} double" for c in names) + ", y double")
    got = {(r.Ticker, r.fold, (r.Date - dt.date(2000, 1, 1)).days): r.predicted
           for r in rolling_refits(df, names, "y", 4, ridge).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
