"""Round 3: pairs of blocks of keys without copies, one long key without a task of its own,
rolling windows without a pass over the frame at every row."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.functions.long_keys import long_diff, long_indicators
from barwise.operators.arma import fit_arma, innovations
from barwise.operators.correlation import correlation_pairs, extreme_correlations


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def returns(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(13):
        days = [i for i in range(150) if rng.random() < 0.7]
        rows += [(f"k{k:02d}", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(rng.normal())) for i in days]
    # no key, no date, no value: these rows meet no other
    rows += [(None, dt.date(2000, 1, 3), 4.0), ("k01", None, 9.0), ("k02", None, 9.0), ("null", dt.date(2000, 1, 3), None)]
    return spark.createDataFrame(rows, "Ticker string, Date date, r double").persist()


def test_blocks_of_extreme_pairs_meet_without_copies(returns):
    """Every bar was shuffled once for every block of keys."""
    p = plan(extreme_correlations(returns, "r", block_keys=2))
    assert "CartesianProduct" in p and "FlatMapGroupsInArrow" not in p


@pytest.mark.parametrize("block,rows", [(1024, 100_000), (1024, 40), (3, 40), (4, 100_000)])
def test_pairs_of_blocks_are_whole(returns, block, rows):
    df = returns.filter("Date IS NOT NULL").toPandas()
    wide = df.dropna().pivot(index="Date", columns="Ticker", values="r")
    c, m = wide.corr(min_periods=2), wide.notna().astype(int)
    n = m.T @ m
    got = {(r.ticker_a, r.ticker_b): r for r in correlation_pairs(returns, "r", block_keys=block, rows_per_task=rows).collect()}
    assert len(got) == 13 * 13 and set(got) == {(a, b) for a in wide for b in wide}
    assert all(got[a, b].n_common == n.loc[a, b] and abs(got[a, b].corr - c.loc[a, b]) < 1e-9 for a, b in got)
    half = correlation_pairs(returns, "r", block_keys=block, rows_per_task=rows, mirror=False)
    assert {(r.ticker_a, r.ticker_b) for r in half.collect()} == {(a, b) for a, b in got if a <= b}


def test_pairs_of_blocks_are_not_shuffled(returns):
    """Partial sums of all pairs went through an exchange for every bucket of dates."""
    p = plan(correlation_pairs(returns, "r", block_keys=3, rows_per_task=40))
    assert "CartesianProduct" in p and "Exchange hashpartitioning" not in p


@pytest.fixture(scope="module")
def one_key(spark):
    rng = np.random.default_rng(9)
    rows = [("ALL", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=700)))]
    return spark.createDataFrame(rows, "Ticker string, Date date, Close double").persist()


def most_rows(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_one_key_has_no_task_of_its_own(spark, one_key):
    """The differences were a window by key, and the means and coefficients of the only
    key were joined by key: all rows in one task."""
    had = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(had, ("32", "false", "-1")):
        spark.conf.set(c, v)
    try:
        diffs = long_diff(one_key, 20, "Close", "value")
        assert diffs.count() == 700 and most_rows(diffs) < 350
        x, part, _ = innovations(diffs.filter("value IS NOT NULL"), "value", 5, 3, chunk_rows=20)
        assert part == ["Ticker", "_chunk"] and x.filter("_own").count() == 699 and most_rows(x) < 500
    finally:
        for c, v in had.items():
            spark.conf.set(c, v)


def test_chunked_orders_are_those_of_the_key(one_key):
    rows = lambda f: {(r.p, r.q): (r.n, round(r.aic, 6), r.is_best) for r in f.collect()}
    diffs = Wn.diff(one_key, "Close", "value").filter("value IS NOT NULL")
    chunked = long_diff(one_key, 20, "Close", "value").filter("value IS NOT NULL")
    want, got = (rows(fit_arma(d, (1, 1, 0, 0), long_ar=5, chunk_rows=c)) for d, c in ((diffs, None), (chunked, 20)))
    assert got == want and len(got) == 4


def test_rolling_from_runs(spark):
    """Means and extremes of frames, with gaps, as the frames give them."""
    rng = np.random.default_rng(4)
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if rng.random() < (0.02 if k == "a" else 0.3) else float(rng.normal() * 10 ** rng.integers(0, 6)))
            for k, n in (("a", 400), ("b", 90), ("c", 1)) for i in range(n)]
    rows += [("n", dt.date(2000, 1, 1) + dt.timedelta(days=i), float("nan") if i == 40 else 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, x double")
    frames = {f"{kind}{n}": (kind, "x", n) for kind in ("mean", "min", "max") for n in (1, 2, 7, 16, 20, 64, 90, 200)}
    aggs = {"mean": F.avg, "min": F.min, "max": F.max}
    got = {(r.Ticker, r.Date): r for r in Wn.add_rolling(df, frames).collect()}
    want = df.withColumns({name: Wn.rolling(aggs[kind], x, n) for name, (kind, x, n) in frames.items()}).collect()
    assert len(got) == len(want) and set(Wn.add_rolling(df, frames).columns) == {"Ticker", "Date", "x", *frames}
    for r in want:
        for c in frames:
            v = got[r.Ticker, r.Date][c]
            assert v is None if r[c] is None else v == pytest.approx(r[c], rel=1e-9, abs=1e-6, nan_ok=True), (r.Ticker, r.Date, c)


def test_rolling_steps_do_not_grow_with_the_frame(spark, one_key):
    """No aggregate over a frame of 50 or 200 rows is left: it takes that many steps a row."""
    bars = one_key.withColumns({c: F.col("Close") for c in ("Open", "High", "Low", "adj_close", "Volume")})
    for df in (Wn.features(bars), Wn.indicators(bars)):
        frames = {int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan(df))}
        assert max(frames) == 29  # the standard deviation's


def test_small_states_are_broadcast(one_key):
    """The states of the chunks met all rows in a shuffle join."""
    bars = one_key.withColumns({c: F.col("Close") for c in ("Open", "High", "Low", "adj_close", "Volume")})
    p = plan(long_indicators(bars, 57))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p and not re.search(r"Exchange hashpartitioning\(coalesce", p)
