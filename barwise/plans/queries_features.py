"""Registered queries: per-key window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.functions.exprs import quantize
from barwise.operators.bars import drop_incomplete
from barwise.plans import sql_features as S
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.schema import FEATURE_COLS
from barwise.sources import files as Fi
from barwise.sources import fixtures as X

K = "Ticker, Date"
W = S.W
QUANT_FEATURES = {"MA7", "MA30", "MA90", "Volatility_30d", "Volume_MA20", "Volume_Ratio"}


def panel(spark, sf):
    """features -> drop incomplete: the reference's df_clean on region bars."""
    return drop_incomplete(Wn.features(X.region_bars(spark, sf)))


PANEL_CTES = X.REGION_BARS_SQL + S.features_ctes("bars") + S.clean_ctes("feat")


def _q_all(df, cols):
    return df.withColumns({c: quantize(c) for c in cols})


@register("calendar", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K}, CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
  CAST(day(Date) AS INTEGER) AS Day, CAST(isodow(Date) - 1 AS INTEGER) AS DayOfWeek,
  CAST(Date = last_day(Date) AS INTEGER) AS Is_Month_End,
  CAST(day(Date) = 1 AS INTEGER) AS Is_Month_Start,
  strftime(Date, '%Y-%m') AS year_month
FROM bars"""))
def q_calendar(spark, sf):
    b = Wn.calendar_cols(X.region_bars(spark, sf))
    return b.select("Ticker", "Date", "Year", "Month", "Day", "DayOfWeek", "Is_Month_End",
                    "Is_Month_Start", F.date_format("Date", "yyyy-MM").alias("year_month"))


@register("moving_averages", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K},
  {q_sql(S.full('avg', 'Close', 7))} AS MA7,
  {q_sql(S.full('avg', 'Close', 30))} AS MA30,
  {q_sql(S.full('avg', 'Close', 90))} AS MA90,
  {q_sql(S.full('avg', 'Close', 50))} AS SMA_50,
  {q_sql(S.full('avg', 'Close', 200))} AS SMA_200
FROM bars"""))
def q_moving_averages(spark, sf):
    b = X.region_bars(spark, sf)
    for n, name in [(7, "MA7"), (30, "MA30"), (90, "MA90"), (50, "SMA_50"), (200, "SMA_200")]:
        b = Wn.sma(b, "Close", n, name)
    return _q_all(b.select("Ticker", "Date", "MA7", "MA30", "MA90", "SMA_50", "SMA_200"),
                  ["MA7", "MA30", "MA90", "SMA_50", "SMA_200"])


@register("volatility", with_ctes(X.REGION_BARS_SQL + [
    f"v0 AS (SELECT *, (Close - Open) / nullif(Open, 0) AS Daily_Return, {S.pct('Close', 1)} AS Return FROM bars)"], f"""
SELECT {K}, Daily_Return,
  {q_sql(S.full('stddev_samp', 'Daily_Return', 30, 10))} AS Volatility_30d,
  {q_sql('(' + S.full('stddev_samp', 'Return', 30) + ') * sqrt(252)')} AS Volatility_30d_ann
FROM v0"""))
def q_volatility(spark, sf):
    from barwise.functions.exprs import intraday_return
    b = X.region_bars(spark, sf).withColumn("Daily_Return", intraday_return())
    b = Wn.pct_change(b, "Close", 1, "Return")
    b = Wn.rolling_std_col(b, "Daily_Return", 30, 10, "Volatility_30d")
    b = Wn.annualized_vol(b, "Return", 30, "Volatility_30d_ann")
    return _q_all(b.select("Ticker", "Date", "Daily_Return", "Volatility_30d", "Volatility_30d_ann"),
                  ["Volatility_30d", "Volatility_30d_ann"])


@register("lags_momentum", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K},
  lag(Close, 1) OVER ({W}) AS Lag_Close_1, lag(Close, 2) OVER ({W}) AS Lag_Close_2,
  lag(Close, 3) OVER ({W}) AS Lag_Close_3, lag(Close, 5) OVER ({W}) AS Lag_Close_5,
  {S.pct('Close', 5)} AS Momentum_5d, {S.pct('Close', 10)} AS Momentum_10d,
  {S.pct('Close', 1)} AS Return, {S.pct('Open', 1)} AS Overnight_Gap,
  (Open / nullif(lag(Close, 1) OVER ({W}), 0) - 1) AS Gap_Close_Open,
  Close - lag(Close, 1) OVER ({W}) AS Close_diff,
  {q_sql(f"CASE WHEN adj_close / nullif(lag(adj_close, 1) OVER ({W}), 0) > 0 THEN ln(adj_close / nullif(lag(adj_close, 1) OVER ({W}), 0)) END")} AS log_return
FROM bars"""))
def q_lags_momentum(spark, sf):
    b = X.region_bars(spark, sf)
    b = Wn.lags(b, "Close", (1, 2, 3, 5))
    b = Wn.pct_change(b, "Close", 5, "Momentum_5d")
    b = Wn.pct_change(b, "Close", 10, "Momentum_10d")
    b = Wn.pct_change(b, "Close", 1, "Return")
    b = Wn.overnight_gap(b)
    b = Wn.overnight_gap(b, gap="close_open", name="Gap_Close_Open")
    b = Wn.diff(b, "Close")
    b = Wn.log_return(b)
    return b.select("Ticker", "Date", "Lag_Close_1", "Lag_Close_2", "Lag_Close_3", "Lag_Close_5",
                    "Momentum_5d", "Momentum_10d", "Return", "Overnight_Gap", "Gap_Close_Open",
                    "Close_diff", quantize("log_return").alias("log_return"))


@register("price_position", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K}, (Close - ({S.full('min', 'Close', 20)})) /
  nullif(({S.full('max', 'Close', 20)}) - ({S.full('min', 'Close', 20)}) + 1e-8, 0) AS Price_Position_20d
FROM bars"""))
def q_price_position(spark, sf):
    return Wn.price_position(X.region_bars(spark, sf)).select("Ticker", "Date", "Price_Position_20d")


@register("volume_features", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K}, {q_sql(S.full('avg', 'Volume', 20))} AS Volume_MA20,
  {q_sql(f"Volume / nullif(({S.full('avg', 'Volume', 20)}) + 1e-6, 0)")} AS Volume_Ratio
FROM bars"""))
def q_volume_features(spark, sf):
    b = Wn.volume_features(X.region_bars(spark, sf))
    return _q_all(b.select("Ticker", "Date", "Volume_MA20", "Volume_Ratio"), ["Volume_MA20", "Volume_Ratio"])


@register("targets", with_ctes(X.REGION_BARS_SQL, f"""
SELECT * FROM (
  SELECT {K}, adj_close, lead(adj_close, 1) OVER ({W}) AS Target_Next_Price,
    CAST(coalesce(lead(adj_close, 1) OVER ({W}) > adj_close, false) AS INTEGER) AS Target_Direction
  FROM bars) t WHERE Target_Next_Price IS NOT NULL"""))
def q_targets(spark, sf):
    b = Wn.targets(X.region_bars(spark, sf), "adj_close")
    return b.select("Ticker", "Date", "adj_close", "Target_Next_Price", "Target_Direction")


@register("cumulative_return", with_ctes(X.REGION_BARS_SQL + S.indicators_ctes("bars"), f"""
SELECT {K}, Return, {q_sql('Cumulative_Return')} AS Cumulative_Return FROM ind"""))
def q_cumulative_return(spark, sf):
    b = Wn.pct_change(X.region_bars(spark, sf), "Close", 1, "Return")
    b = Wn.cumulative_return(b, "Return")
    return b.select("Ticker", "Date", "Return", quantize("Cumulative_Return").alias("Cumulative_Return"))


@register("drawdown", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K}, max(adj_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max,
  (max(adj_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - adj_close)
   / nullif(max(adj_close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS drawdown
FROM bars"""))
def q_drawdown(spark, sf):
    b = X.region_bars(spark, sf)
    b = b.withColumn("running_max", F.max("adj_close").over(Wn.running()))
    return Wn.drawdown(b).select("Ticker", "Date", "running_max", "drawdown")


LOOKBACK = 60


@register("sliding_windows", with_ctes(X.REGION_BARS_SQL + [f"""
sw AS (SELECT {K}, list(Close) OVER ({W} ROWS BETWEEN {LOOKBACK} PRECEDING AND 1 PRECEDING) AS x,
         Close AS y FROM bars)"""], f"""
SELECT {K}, CAST(len(x) AS INTEGER) AS x_size, x[1] AS x_first, x[len(x)] AS x_last,
  {q_sql('list_sum(x)')} AS x_sum, y
FROM sw WHERE len(x) = {LOOKBACK}"""))
def q_sliding_windows(spark, sf):
    b = Wn.sliding_windows(X.region_bars(spark, sf), "Close", LOOKBACK)
    return b.select("Ticker", "Date", F.size("x").alias("x_size"), F.col("x")[0].alias("x_first"),
                    F.element_at("x", -1).alias("x_last"),
                    quantize(F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v)).alias("x_sum"), "y")


@register("features", with_ctes(PANEL_CTES, "SELECT " + ", ".join(
    S.BASE + [q_sql(c) + f" AS {c}" if c in QUANT_FEATURES else c for c in FEATURE_COLS])
    + " FROM df_clean"))
def q_features(spark, sf):
    return _q_all(panel(spark, sf), QUANT_FEATURES)


def bucketed_panel(spark, sf, buckets: int = 16):
    """Supplier bars as a bucketed table in the shared checkpoint folder."""
    path = Fi.scratch_path(spark, "bars_by_key")
    name = "bars_by_key_" + path.rsplit("-", 1)[1]
    return Fi.write_bucketed(X.supplier_bars(spark, sf), name, path, buckets)


@register("bucketed_features", with_ctes(X.SUPPLIER_BARS_SQL + S.features_ctes("sbars") + S.clean_ctes("feat"), "SELECT " + ", ".join(
    S.BASE + [q_sql(c) + f" AS {c}" if c in QUANT_FEATURES else c for c in FEATURE_COLS]) + " FROM df_clean"))
def q_bucketed_features(spark, sf):
    """The panel from a table bucketed by key: no exchange below the windows."""
    return _q_all(drop_incomplete(Wn.features(bucketed_panel(spark, sf))), QUANT_FEATURES)


_IND = ["SMA_50", "SMA_200", "Volatility_30d", "Cumulative_Return"]


@register("indicators", with_ctes(X.REGION_BARS_SQL + S.indicators_ctes("bars"), "SELECT " + ", ".join(
    S.BASE + ["Return"] + [q_sql(c) + f" AS {c}" for c in _IND]) + " FROM ind"))
def q_indicators(spark, sf):
    return _q_all(Wn.indicators(X.region_bars(spark, sf)), _IND)


@register("row_index", with_ctes(X.REGION_BARS_SQL, f"""
SELECT {K}, CAST(row_number() OVER ({W}) AS INTEGER) AS row_in_key FROM bars"""))
def q_row_index(spark, sf):
    return Wn.with_row_index(X.region_bars(spark, sf)).select("Ticker", "Date", "row_in_key")


@register("lag_matrix", with_ctes(X.REGION_BARS_SQL, "SELECT * FROM (SELECT Ticker, Date, "
    + ", ".join(f"lag(Close, {k}) OVER ({W}) AS lag_{k}" for k in range(1, 21))
    + ", Close AS target FROM bars) t WHERE COLUMNS(*) IS NOT NULL"))
def q_lag_matrix(spark, sf):
    b = Wn.lag_matrix(X.region_bars(spark, sf), "Close", 20)
    return b.select("Ticker", "Date", *[f"lag_{k}" for k in range(1, 21)], "target")
