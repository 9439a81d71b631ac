"""Property checks on the sf0.001 tables."""

import math

import pytest
from pyspark.sql import functions as F

from barwise.operators import metrics as Me
from barwise.operators import splits as Sp
from barwise.operators import stats as St
from barwise.operators import timeseries as Ts
from barwise.operators.correlation import correlation_pairs
from barwise.plans.queries_features import panel
from barwise.sources import fixtures as X
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def pnl(spark):
    return panel(spark, SF_SMALL).cache()


def test_corr_symmetric_unit_diagonal(spark, pnl):
    c = {(r.ticker_a, r.ticker_b): r.corr for r in correlation_pairs(pnl, "Daily_Return").collect()}
    for (a, b), v in c.items():
        assert math.isclose(v, c[(b, a)], abs_tol=1e-12)
        if a == b:
            assert math.isclose(v, 1.0, abs_tol=1e-9)
        assert -1 - 1e-9 <= v <= 1 + 1e-9


def test_corr_blocked_equals_single_block(spark, pnl):
    one = {(r.ticker_a, r.ticker_b): r.corr for r in correlation_pairs(pnl, "Daily_Return").collect()}
    blk = {(r.ticker_a, r.ticker_b): r.corr
           for r in correlation_pairs(pnl, "Daily_Return", block_keys=2, rows_per_task=500).collect()}
    assert one.keys() == blk.keys()
    for k in one:
        assert math.isclose(one[k], blk[k], abs_tol=1e-9)


@pytest.mark.parametrize("how", ["rows", "per_key", "time"])
def test_splits_partition_the_rows(spark, pnl, how):
    base = pnl.select("Ticker", "Date")
    s = {"rows": Sp.split_rows, "per_key": Sp.split_per_key, "time": Sp.split_time}[how](base, 0.8)
    assert s.count() == base.count()
    assert s.select("Ticker", "Date").distinct().count() == base.count()
    if how == "time":
        mx = s.filter("split = 'train'").agg(F.max("Date")).first()[0]
        mn = s.filter("split = 'test'").agg(F.min("Date")).first()[0]
        assert mx < mn


def test_global_index_is_dense(spark, pnl):
    from barwise.functions.ordering import global_index
    idx = [r.i for r in global_index(pnl.select("Ticker", "Date"), ["Ticker", "Date"], "i").collect()]
    assert sorted(idx) == list(range(len(idx)))


def test_business_days_are_weekdays(spark):
    bd = Ts.business_days(X.region_bars(spark, SF_SMALL), 30)
    assert bd.filter(F.weekday("Date") >= 5).count() == 0
    assert bd.groupBy("Ticker").count().filter("count != 30").count() == 0


def test_perfect_predictions_metrics(spark, pnl):
    p = pnl.select(F.lit("m").alias("model"), "Ticker", "Date", F.col("Close").alias("actual"),
                   F.col("Close").alias("predicted"))
    m = Me.regression_metrics(p).first()
    assert (m.mae, m.rmse, m.mape_pct, m.max_error) == (0.0, 0.0, 0.0, 0.0)
    assert m.r2 == 1.0 and m.explained_variance == 1.0


def test_label_shares_sum_to_one(spark, pnl):
    from barwise.plans.queries_stats import return_label
    sh = St.label_shares(pnl.withColumn("label", return_label()), "label")
    for r in sh.groupBy("Ticker").agg(F.sum("share").alias("s")).collect():
        assert math.isclose(r.s, 1.0, abs_tol=1e-12)


def test_histogram_counts_all_values(spark):
    b = X.region_bars(spark, SF_SMALL)
    from barwise.functions import windows as Wn
    r = Wn.pct_change(b, "Close", 1, "Return")
    h = St.histogram(r, "Return", 70, scale=100.0)
    got = {x.Ticker: x.n for x in h.groupBy("Ticker").agg(F.sum("n").alias("n")).collect()}
    want = {x.Ticker: x.n for x in r.groupBy("Ticker").agg(F.count("Return").alias("n")).collect()}
    assert got == want
    assert h.groupBy("Ticker").count().filter("count != 70").count() == 0


def test_partition_invariance(spark):
    from barwise.plans import load_all
    reg = load_all()
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = {}
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out[n] = sorted(reg["features"][0](spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out["1"] == out["8"]
