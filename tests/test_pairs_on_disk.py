"""supplier_correlation: what the pairs of blocks leave on disk and write."""

import math
import os

import pytest
from pyspark.sql import functions as F

from barwise.operators import correlation as C
from barwise.operators.bars import ohlcv_bars


def shuffled(spark):
    """Shuffle files that Spark holds: path -> bytes."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for t in top for d, _, files in os.walk(t) for x in files if x.startswith("shuffle_")}


@pytest.fixture(scope="module")
def walks(spark):
    """60 keys of 500 days each, nine in ten of them there."""
    days = spark.range(30_000).select((F.col("id") % 60).cast("string").alias("Ticker"),
                                      F.date_add(F.lit("2000-01-01"), F.floor(F.col("id") / 60).cast("int")).alias("Date"),
                                      (F.rand(3) - 0.5).alias("r"), F.rand(4).alias("there"))
    return days.filter("there < 0.9").drop("there").persist()


def test_rows_are_shuffled_once_for_their_blocks(spark, walks):
    """Rows met their keys in a shuffle join, then went through an exchange to be packed and another one packed."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        packed = C._blocks(walks, "r", "Ticker", "Date", 10, 1000, False)[0]
        assert {r["count"] for r in packed.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("blk").alias("count")).collect()} == {1}
        plan = packed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count(" Exchange ") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_shuffle_files_of_the_bars_go(spark, walks):
    """They stayed until the driver collected garbage: all shuffles of the query lay on disk together."""
    bars = walks.repartition(5, "Ticker")
    had = shuffled(spark)
    pairs = C.correlation_pairs(bars, "r", block_keys=10)
    left = sum(n for f, n in shuffled(spark).items() if f not in had)
    assert left < 100_000  # the bars take 400,000; shuffles of the 60 keys are left
    assert pairs.count() == 3600


def test_both_orders_lie_together(spark, tmp_path):
    """Two rows of a pair alternated, so that no run of keys or values was left to the file's compression."""
    rows = spark.range(0, 300 * 12, 1, 4).select((F.col("id") % 300).cast("string").alias("Ticker"),
                                                F.date_add(F.lit("2000-01-01"), F.floor(F.col("id") / 300).cast("int")).alias("Date"), F.rand(5).alias("r"))
    C.correlation_pairs(rows, "r", block_keys=150).coalesce(1).write.parquet(f"{tmp_path}/out")
    size = sum(os.path.getsize(f"{tmp_path}/out/{x}") for x in os.listdir(f"{tmp_path}/out") if x.endswith(".parquet"))
    assert spark.read.parquet(f"{tmp_path}/out").distinct().count() == 90_000 and size < 6.5 * 90_000


def test_unknown_pairs_of_blocks(spark):
    """A constant series and too few dates give no correlation, NaN stays, as in one block."""
    rows = [(k, f"2000-01-{d:02d}", v) for k, f in (("a", float), ("b", lambda d: d * d % 7 + 0.5), ("c", lambda d: 3.0),
            ("d", lambda d: math.nan if d == 4 else float(-d)), ("e", lambda d: d % 3 + 0.0)) for d in range(1, 2 if k == "e" else 12) for v in [f(d)]]
    df = spark.createDataFrame(rows, "Ticker string, Date string, r double").withColumn("Date", F.col("Date").cast("date"))
    one, blocks = ({(r.ticker_a, r.ticker_b): (r.n_common, r.corr if r.corr is None or math.isnan(r.corr) else round(r.corr, 9))
                    for r in C.correlation_pairs(df, "r", block_keys=k).collect()} for k in (1024, 2))
    assert len(one) == 25 and str(sorted(one.items())) == str(sorted(blocks.items()))
    assert one["a", "c"] == (11, None) and one["a", "e"] == (1, None) and math.isnan(one["d", "a"][1])
    half = C.correlation_pairs(df, "r", block_keys=2, mirror=False).collect()
    assert sorted((r.ticker_a, r.ticker_b) for r in half) == sorted(p for p in one if p[0] <= p[1])


def test_bars_from_their_first_and_last_order_key(spark):
    """Every price of a bar's end had a copy of the whole order key beside it in the shuffle."""
    rows = [(k, f"2000-01-0{d} 0{h}:00:00", o, p, q) for k in (1, 2, None) for d in (1, 2) for h, o, p, q in
            ((1, 5, 8.0, 2.0), (2, 3, 9.0, 0.0), (3, None, None, 4.0), (4, 9 + d, 7.0 + d, None if d == 2 else 3.0), (5, 9 + d, 6.5, 2.5))]
    df = spark.createDataFrame(rows, "k int, ts string, o int, p double, q double").withColumn("ts", F.col("ts").cast("timestamp"))
    price, adj = (lambda c: F.try_divide(c("p"), c("q"))), (lambda c: c("p") * c("q"))
    order = {"key": "k", "ts": "ts", "volume": "q", "order": ["o", "p", "q"]}
    want = ohlcv_bars(df.withColumn("px", price(F.col)), price="px", adj=adj(F.col), **order)
    got = ohlcv_bars(df, price=price, adj=adj, of_order=True, **order)
    assert got.columns == want.columns and got.count() == 6 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    last = got.select("Close")
    assert "max_by" not in (p := last._jdf.queryExecution().optimizedPlan().toString()) and "_first" not in p


def test_lines_are_off_the_disk_when_bars_go_to_their_keys(spark, tmp_path):
    """The shuffle of the lines lay beside that of the bars and the written returns."""
    from barwise.plans.queries_stats import _supplier_returns
    lines = spark.range(0, 400, 1, 4).select("id", F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).cast("long").alias("l_partkey"),
        (F.col("id") % 4).alias("l_suppkey"), (F.col("id") + 10.0).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"), F.lit(0.1).cast("double").alias("l_discount"),
        F.date_add(F.lit("2000-01-01"), F.floor(F.col("id") / 8).cast("int")).cast("timestamp").alias("l_shipdate"))
    lines.drop("id").write.parquet(f"{tmp_path}/lineitem.parquet")
    had = shuffled(spark)
    r = _supplier_returns(spark, str(tmp_path))
    assert not shuffled(spark).keys() - had.keys() and "parquet" not in r._jdf.queryExecution().executedPlan().toString()
    assert r.count() == 200 and r.filter("r IS NULL").count() == 4
