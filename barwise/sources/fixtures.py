"""Bar tables derived from the driver's TPC-H-like tables.

Every builder reads the driver parquet and derives bars with Spark, so its work
grows with the input. Each has a DuckDB SQL twin (``*_SQL``: a list of CTEs)
used by the correctness oracle.

* ``region_bars``   key = region name (5 keys), the main fixture
* ``supplier_bars`` key = supplier key (1,000 keys at sf0.1), the scale variant
* ``series_bars``   all supplier bars as one key, the variant for long keys
* ``walk_bars``     integer random walk per key (non-stationary)
* ``dirty_bars``    deterministic dirt on region bars (duplicates, gaps, NULL keys)
* ``tick_bars``     daily bars of the ``events`` stream
* ``fundamentals``  dimension with holes; ``universe`` two ticker groups
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.operators.bars import ohlcv_bars
from barwise.session import broadcast_if_small
from barwise.sources.tables import table

# Total order of lineitem rows inside a day (the first four are not unique).
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
              "l_extendedprice", "l_quantity", "l_discount"]
LINE_COLS = LINE_ORDER + ["l_shipdate"]


def _damped_price(c=F.col) -> F.Column:
    # quantity >= 1 in the driver data; try_divide keeps ANSI mode from raising
    return F.lit(100.0) + F.try_divide(c("l_extendedprice"), c("l_quantity")) / F.lit(1000.0)


def _supplier_region(spark, sf_dir) -> DataFrame:
    """supplier -> region name. nation (25 rows) and region (5 rows) have a fixed
    size in TPC-H, so broadcasting them is safe. The result is broadcast into
    the fact join only when the supplier scan is under the broadcast threshold
    (it grows with the scale factor); otherwise the join is a shuffle join with
    AQE skew handling."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    dims = (supp.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "r_name"))
    return broadcast_if_small(dims, probe=supp)


def region_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x supplier x nation x region -> daily bars per region.

    The supplier side is joined by Catalyst's choice (broadcast only under the
    size threshold, sort-merge with AQE skew handling otherwise).
    """
    li = table(spark, sf_dir, "lineitem").select(*LINE_COLS)
    j = li.join(_supplier_region(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.withColumn("px", _damped_price())
    return ohlcv_bars(j, key="r_name", ts="l_shipdate", price="px", volume="l_quantity",
                      order=LINE_ORDER, adj=F.col("px") * (F.lit(1.0) - F.col("l_discount")))


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier key (no join needed)."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_COLS)
    return ohlcv_bars(li, key="l_suppkey", ts="l_shipdate", price=_damped_price, volume="l_quantity",
                      order=[c for c in LINE_ORDER if c != "l_suppkey"],  # equal inside a bar
                      adj=lambda c: _damped_price(c) * (F.lit(1.0) - c("l_discount")), of_order=True)


def series_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplier bars strung into one series, as a key of intraday bars: the
    supplier's number is the second of the day."""
    b = supplier_bars(spark, sf_dir)
    at = F.timestamp_seconds(F.unix_date("Date") * F.lit(86_400) + F.col("Ticker").cast("bigint"))
    return b.withColumn("Date", at.cast("timestamp_ntz")).withColumn("Ticker", F.lit("ALL"))


def walk_bars(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Close = adj_close = 500 + running sum of (Volume mod 3) - 1: an integer walk."""
    b = bars if bars is not None else region_bars(spark, sf_dir)
    w = Window.partitionBy("Ticker").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    step = (F.col("Volume").cast("bigint") % 3) - 1
    walk = (F.lit(500) + F.sum(step).over(w)).cast("double")
    return b.withColumn("Close", walk).withColumn("adj_close", F.col("Close"))


def dirty_bars(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """Region bars with deterministic dirt and a source-order column ``src``."""
    b = bars if bars is not None else region_bars(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("Ticker").orderBy("Date"))
    b = b.withColumn("_rn", rn)
    gap = ((F.dayofmonth("Date") % 7) == 0) | (F.col("_rn") <= 2)
    prices = ["Open", "High", "Low", "Close", "adj_close"]
    dirty = b.withColumns({c: F.when(~gap, F.col(c)) for c in prices})
    dirty = dirty.withColumn("Volume", F.when(~gap & (F.col("Ticker") != "ASIA"), F.col("Volume")))
    dirty = dirty.drop("_rn")
    orig = dirty.withColumn("src", F.lit(0))
    dups = (dirty.filter(F.dayofmonth("Date") == 1)
            .withColumns({c: F.col(c) * F.lit(1.5) for c in prices})
            .withColumn("src", F.lit(1)))
    nokey = (dirty.filter(F.dayofmonth("Date") == 31)
             .withColumn("Ticker", F.lit(None).cast("string")).withColumn("src", F.lit(2)))
    return orig.unionByName(dups).unionByName(nokey)


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the events stream: key event_type, price value, one volume unit per tick."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return ohlcv_bars(ev, key="event_type", ts="ts", price="value", volume=None,
                      order=["ts", "event_id"])


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fundamentals per region with holes: none for EUROPE, NULL cap for ASIA, P/E 0 for AFRICA."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    j = s.join(_supplier_region(spark, sf_dir), "s_suppkey")
    agg = j.groupBy(F.col("r_name").alias("Ticker")).agg(
        (F.sum("s_acctbal") * F.lit(1e9)).alias("marketCap"),
        F.count(F.lit(1)).cast("double").alias("trailingPE"))
    return (agg.filter(F.col("Ticker") != "EUROPE")
            .select("Ticker",
                    F.concat(F.col("Ticker"), F.lit(" index")).alias("longName"),
                    F.when(F.col("Ticker") != "ASIA", F.col("marketCap")).alias("marketCap"),
                    F.when(F.col("Ticker") == "AFRICA", F.lit(0.0))
                     .otherwise(F.col("trailingPE")).alias("trailingPE")))


# Ticker universe (fixed values): two groups of region names.
UNIVERSE = [("group_a", "AFRICA"), ("group_a", "AMERICA"), ("group_a", "ASIA"),
            ("group_b", "EUROPE"), ("group_b", "MIDDLE EAST")]


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNIVERSE, "group string, Ticker string")


# ------------------------------------------------------------------ SQL twins
_LINE_ORDER_SQL = ", ".join(LINE_ORDER)

REGION_BARS_SQL = [f"""
li AS (
  SELECT r_name AS Ticker, CAST(l_shipdate AS DATE) AS Date,
         100 + l_extendedprice / l_quantity / 1000 AS px,
         l_discount, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)""", f"""
bars AS (
  SELECT Ticker, Date,
         first(px ORDER BY {_LINE_ORDER_SQL}) AS Open,
         max(px) AS High, min(px) AS Low,
         last(px ORDER BY {_LINE_ORDER_SQL}) AS Close,
         last(px * (1 - l_discount) ORDER BY {_LINE_ORDER_SQL}) AS adj_close,
         sum(l_quantity) AS Volume
  FROM li GROUP BY Ticker, Date)"""]

SUPPLIER_BARS_SQL = [f"""
sli AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS Ticker, CAST(l_shipdate AS DATE) AS Date,
         100 + l_extendedprice / l_quantity / 1000 AS px,
         l_discount, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)""", f"""
sbars AS (
  SELECT Ticker, Date,
         first(px ORDER BY {_LINE_ORDER_SQL}) AS Open,
         max(px) AS High, min(px) AS Low,
         last(px ORDER BY {_LINE_ORDER_SQL}) AS Close,
         last(px * (1 - l_discount) ORDER BY {_LINE_ORDER_SQL}) AS adj_close,
         sum(l_quantity) AS Volume
  FROM sli GROUP BY Ticker, Date)"""]

SERIES_BARS_SQL = SUPPLIER_BARS_SQL + ["""
series AS (
  SELECT 'ALL' AS Ticker, CAST(Date AS TIMESTAMP) + to_seconds(CAST(Ticker AS BIGINT)) AS Date,
         Open, High, Low, Close, adj_close, Volume
  FROM sbars)"""]

WALK_BARS_SQL = REGION_BARS_SQL + ["""
walk AS (
  SELECT Ticker, Date, Open, High, Low,
         CAST(500 + sum((CAST(Volume AS BIGINT) % 3) - 1) OVER (
              PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS DOUBLE) AS Close,
         CAST(500 + sum((CAST(Volume AS BIGINT) % 3) - 1) OVER (
              PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS DOUBLE) AS adj_close,
         Volume
  FROM bars)"""]

DIRTY_BARS_SQL = REGION_BARS_SQL + ["""
b0 AS (
  SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS rn FROM bars)""", """
dirt AS (
  SELECT Ticker, Date,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) THEN Open END AS Open,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) THEN High END AS High,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) THEN Low END AS Low,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) THEN Close END AS Close,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) THEN adj_close END AS adj_close,
         CASE WHEN NOT (day(Date) % 7 = 0 OR rn <= 2) AND Ticker <> 'ASIA' THEN Volume END AS Volume
  FROM b0)""", """
dirty AS (
  SELECT Ticker, Date, Open, High, Low, Close, adj_close, Volume, 0 AS src FROM dirt
  UNION ALL
  SELECT Ticker, Date, Open * 1.5, High * 1.5, Low * 1.5, Close * 1.5, adj_close * 1.5, Volume, 1
  FROM dirt WHERE day(Date) = 1
  UNION ALL
  SELECT CAST(NULL AS VARCHAR), Date, Open, High, Low, Close, adj_close, Volume, 2
  FROM dirt WHERE day(Date) = 31)"""]

TICK_BARS_SQL = ["""
tbars AS (
  SELECT event_type AS Ticker, CAST(ts AS DATE) AS Date,
         first(value ORDER BY ts, event_id) AS Open,
         max(value) AS High, min(value) AS Low,
         last(value ORDER BY ts, event_id) AS Close,
         last(value ORDER BY ts, event_id) AS adj_close,
         CAST(count(*) AS DOUBLE) AS Volume
  FROM events GROUP BY event_type, CAST(ts AS DATE))"""]

FUNDAMENTALS_SQL = ["""
fagg AS (
  SELECT r_name AS Ticker, sum(s_acctbal) * 1e9 AS marketCap, CAST(count(*) AS DOUBLE) AS trailingPE
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name)""", """
fundamentals AS (
  SELECT Ticker, Ticker || ' index' AS longName,
         CASE WHEN Ticker <> 'ASIA' THEN marketCap END AS marketCap,
         CASE WHEN Ticker = 'AFRICA' THEN 0.0 ELSE trailingPE END AS trailingPE
  FROM fagg WHERE Ticker <> 'EUROPE')"""]

UNIVERSE_SQL = ["universe AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{g}', '{t}')" for g, t in UNIVERSE) + ") AS u(\"group\", Ticker))"]
