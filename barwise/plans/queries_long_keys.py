"""Registered queries: window features over one very long key."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions import long_keys as L
from barwise.functions.exprs import quantize
from barwise.plans import sql_features as S
from barwise.plans.queries_bars import _FILL_SQL
from barwise.plans.queries_features import _IND, QUANT_FEATURES
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.schema import FEATURE_COLS, OHLCV
from barwise.sources import fixtures as X

#: 18 chunks of the one key at sf0.01
CHUNK = 3_000
#: running products over tens of thousands of rows differ by more than one ulp
PRODUCT_BITS = 12


def _stamped(df):
    return df.withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss"))


def series_gaps(spark, sf):
    """The one series with gaps: every seventh day of a month, January and March."""
    gap = (F.dayofmonth("Date") % 7 == 0) | F.month("Date").isin(1, 3)
    return X.series_bars(spark, sf).withColumns({c: F.when(~gap, F.col(c)) for c in OHLCV})


STAMP = "strftime(Date, '%Y-%m-%d %H:%M:%S') AS Date"
OUT = ["Ticker", STAMP, *S.BASE[2:]]

GAPS_SQL = X.SERIES_BARS_SQL + ["gaps AS (SELECT Ticker, Date, " + ", ".join(
    f"CASE WHEN NOT (day(Date) % 7 = 0 OR month(Date) IN (1, 3)) THEN {c} END AS {c}" for c in OHLCV) + ", 0 AS src FROM series)"]


@register("long_features", with_ctes(X.SERIES_BARS_SQL + S.features_ctes("series"), "SELECT " + ", ".join(
    OUT + [q_sql(c) + f" AS {c}" if c in QUANT_FEATURES else c for c in FEATURE_COLS]) + " FROM feat"))
def q_long_features(spark, sf):
    out = L.long_features(X.series_bars(spark, sf), CHUNK)
    return _stamped(out.withColumns({c: quantize(c) for c in QUANT_FEATURES}))


@register("long_indicators", with_ctes(X.SERIES_BARS_SQL + S.indicators_ctes("series"), "SELECT " + ", ".join(
    OUT + ["Return"] + [f"{q_sql(c, PRODUCT_BITS)} AS {c}" for c in _IND]) + " FROM ind"))
def q_long_indicators(spark, sf):
    out = L.long_indicators(X.series_bars(spark, sf), CHUNK)
    return _stamped(out.withColumns({c: quantize(c, PRODUCT_BITS) for c in _IND}))


@register("long_drawdown", with_ctes(X.SERIES_BARS_SQL + [f"""
pk AS (SELECT Ticker, Date, adj_close, max(adj_close) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max
  FROM series)"""], f"SELECT Ticker, {STAMP}, running_max, (running_max - adj_close) / nullif(running_max, 0) AS drawdown FROM pk"))
def q_long_drawdown(spark, sf):
    return _stamped(L.long_drawdown(X.series_bars(spark, sf), CHUNK).select("Ticker", "Date", "running_max", "drawdown"))


@register("long_fill_gaps", with_ctes(GAPS_SQL, f"SELECT Ticker, {STAMP}, " + ", ".join(OHLCV) + " FROM ("
                                      + _FILL_SQL.format(src="gaps") + ") f"))
def q_long_fill_gaps(spark, sf):
    return _stamped(L.long_fill_gaps(series_gaps(spark, sf), CHUNK).select("Ticker", "Date", *OHLCV))


@register("long_row_index", with_ctes(X.SERIES_BARS_SQL, f"""
SELECT Ticker, {STAMP}, row_number() OVER ({S.W}) AS row_in_key FROM series"""))
def q_long_row_index(spark, sf):
    return _stamped(L.long_row_index(X.series_bars(spark, sf), CHUNK).select("Ticker", "Date", "row_in_key"))
