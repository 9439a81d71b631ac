"""Chunked windows give what per-key windows give, wherever the chunks lie."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barwise.functions import long_keys as L
from barwise.functions import windows as Wn
from barwise.operators.bars import fill_gaps

COLS = ["Open", "High", "Low", "Close", "adj_close", "Volume"]


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(11), []
    for key, n in [("long", 900), ("a", 3), ("b", 1), ("mid", 260), (None, 120), ("z", 240)]:
        for i in range(n):
            gap = i < 4 or rng.random() < 0.2 or 300 <= i < 500
            v = [None if gap or rng.random() < 0.1 else round(100 + rng.gauss(0, 5), 2) for _ in COLS]
            rows.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=2 * i), *v))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "Ticker string, Date date, " + ", ".join(f"{c} double" for c in COLS))
    return df.persist()


def same(a, b, digits=9):
    def rows(df):
        cols = sorted(df.columns)
        return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in (r[c] for c in cols))
                       for r in df.collect()), key=str)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("rows", [7, 64, 250, 5000])
def test_equal_to_windows(bars, rows):
    same(L.long_features(bars, rows), Wn.features(bars))
    same(L.long_indicators(bars, rows), Wn.indicators(bars))
    same(L.long_fill_gaps(bars, rows), fill_gaps(bars))
    peak = bars.withColumn("running_max", F.max("adj_close").over(Wn.running()))
    same(L.long_drawdown(bars, rows), Wn.drawdown(peak))
    same(L.long_row_index(bars, rows), Wn.with_row_index(bars))
    r = Wn.pct_change(bars, "Close", 1, "Return")
    same(L.long_cumulative_return(r, rows), Wn.cumulative_return(r))


def test_empty(bars):
    none = bars.limit(0)
    for f in (L.long_features, L.long_indicators, L.long_fill_gaps, L.long_drawdown, L.long_row_index):
        assert f(none).count() == 0


def test_one_key_is_dealt_to_many_tasks(spark, bars):
    """A key of 900 rows in 16 chunks: no task of the windows holds more than a
    few chunks and their halos, where a window by key has one task."""
    key = bars.filter("Ticker = 'long'")
    had = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = L.cut_keys(key, 199, 0, 57)
        sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
        assert cut.filter("_own").count() == 900 and len(sizes) >= 16 and max(sizes) <= 57 + 199

        def tasks(df):
            return len({r.p for r in df.select("SMA_200", F.spark_partition_id().alias("p")).collect()})

        assert tasks(L.long_indicators(key, 57)) >= 10
        assert tasks(Wn.indicators(key)) == 1
    finally:
        for c, v in had.items():
            spark.conf.set(c, v)
