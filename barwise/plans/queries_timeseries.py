"""Registered queries: unit-root tests, AR models, seasonal and window
regressors, forecast calendars (M10-M13, M15, K1-K3)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.functions.long_keys import long_diff
from barwise.functions.windows import by_key
from barwise.operators import arma as Ar
from barwise.operators import timeseries as Ts
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.sources import fixtures as X

W = "PARTITION BY Ticker ORDER BY Date"


def _crit_sql(level):
    b0, b1, b2, b3 = Ts.CRIT_C[level]
    n = "CAST(n_obs AS DOUBLE)"
    return (f"CAST({b0!r} AS DOUBLE) + CAST({b1!r} AS DOUBLE) / {n} + CAST({b2!r} AS DOUBLE) / ({n} * {n})"
            f" + CAST({b3!r} AS DOUBLE) / ({n} * {n} * {n})")


def _df_sql(src):
    return [f"""dfx AS (SELECT Ticker, lag(adj_close, 1) OVER ({W}) AS yl,
  adj_close - lag(adj_close, 1) OVER ({W}) AS dy FROM {src})""", """dfa AS (SELECT Ticker,
  regr_count(dy, yl) AS n_obs, regr_slope(dy, yl) AS gamma,
  regr_slope(dy, yl) / sqrt((regr_syy(dy, yl) - regr_sxy(dy, yl) * regr_sxy(dy, yl) / regr_sxx(dy, yl))
                            / (regr_count(dy, yl) - 2) / regr_sxx(dy, yl)) AS t_stat
  FROM dfx GROUP BY Ticker)""", "dft AS (SELECT Ticker, n_obs, gamma, t_stat, " + ", ".join(
        f"{_crit_sql(lv)} AS crit_{lv[:-1]}" for lv in Ts.CRIT_C) + " FROM dfa)"]


DF_OUT = f"""SELECT Ticker, n_obs, {q_sql('gamma')} AS gamma, {q_sql('t_stat')} AS t_stat,
  {q_sql('crit_1')} AS crit_1, {q_sql('crit_5')} AS crit_5, {q_sql('crit_10')} AS crit_10,
  t_stat < crit_5 AS stationary FROM dft"""
DF_Q = ["gamma", "t_stat", "crit_1", "crit_5", "crit_10"]


def _dfq(df):
    return df.withColumns({c: quantize(c) for c in DF_Q})


@register("df_test_bars", with_ctes(X.REGION_BARS_SQL + _df_sql("bars"), DF_OUT))
def q_df_test_bars(spark, sf):
    return _dfq(Ts.df_test(X.region_bars(spark, sf)))


@register("df_test_walk", with_ctes(X.WALK_BARS_SQL + _df_sql("walk"), DF_OUT))
def q_df_test_walk(spark, sf):
    return _dfq(Ts.df_test(X.walk_bars(spark, sf)))


@register("choose_series", with_ctes(X.WALK_BARS_SQL + _df_sql("walk"), """
SELECT Ticker, CASE WHEN coalesce(t_stat < crit_5, false) THEN 'Yes' ELSE 'No' END AS Price_Stationary,
  CASE WHEN coalesce(t_stat < crit_5, false) THEN 'price' ELSE 'log_return' END AS Series_Used
FROM dft"""))
def q_choose_series(spark, sf):
    return Ts.choose_series(Ts.df_test(X.walk_bars(spark, sf)))


AR1_CTES = X.WALK_BARS_SQL + [f"""
a1x AS (SELECT Ticker, adj_close AS y, lag(adj_close, 1) OVER ({W}) AS yl FROM walk)""",
    """a1 AS (SELECT Ticker, regr_count(y, yl) AS n_obs, regr_slope(y, yl) AS slope,
  regr_intercept(y, yl) AS intercept FROM a1x GROUP BY Ticker)"""]


def ar1_fit(df, price="adj_close", key="Ticker", date="Date"):
    """AR(1) on levels: y_t = intercept + slope * y_(t-1), per key."""
    yl = F.lag(F.col(price), 1).over(by_key(key, date))
    x = df.select(key, F.col(price).alias("_y"), yl.alias("_yl"))
    return x.groupBy(key).agg(F.regr_count("_y", "_yl").alias("n_obs"),
                              F.regr_slope("_y", "_yl").alias("slope"),
                              F.regr_intercept("_y", "_yl").alias("intercept"))


@register("ar1", with_ctes(AR1_CTES, f"""
SELECT Ticker, n_obs, {q_sql('slope')} AS slope, {q_sql('intercept')} AS intercept FROM a1"""))
def q_ar1(spark, sf):
    f = ar1_fit(X.walk_bars(spark, sf))
    return f.withColumns({"slope": quantize("slope"), "intercept": quantize("intercept")})


H = 30


@register("business_days", with_ctes(X.REGION_BARS_SQL, f"""
SELECT Ticker, Date, step FROM (
  SELECT Ticker, CAST(d AS DATE) AS Date,
    CAST(row_number() OVER (PARTITION BY Ticker ORDER BY d) AS INTEGER) AS step
  FROM (SELECT Ticker, unnest(generate_series(CAST(last + 1 AS TIMESTAMP),
          CAST(last + {2 * H + 7} AS TIMESTAMP), INTERVAL 1 DAY)) AS d
        FROM (SELECT Ticker, max(Date) AS last FROM bars GROUP BY Ticker) l) x
  WHERE isodow(d) <= 5) t WHERE step <= {H}"""))
def q_business_days(spark, sf):
    return Ts.business_days(X.region_bars(spark, sf), H)


@register("calendar_days", with_ctes(X.REGION_BARS_SQL, """
SELECT Ticker, CAST(s AS INTEGER) AS step, CAST(last + CAST(s AS INTEGER) AS DATE) AS Date
FROM (SELECT Ticker, max(Date) AS last FROM bars GROUP BY Ticker) l, (SELECT unnest(range(1, 61)) AS s) r"""))
def q_calendar_days(spark, sf):
    return Ts.calendar_days(X.region_bars(spark, sf), 60).select(
        "Ticker", F.col("step").cast("int").alias("step"), "Date")


@register("forecast_table", with_ctes(AR1_CTES + [f"""
lastv AS (SELECT Ticker, arg_max(adj_close, Date) AS y0, max(Date) AS last FROM walk GROUP BY Ticker)""",
    f"""bd AS (SELECT * FROM (
  SELECT Ticker, CAST(d AS DATE) AS Date,
    CAST(row_number() OVER (PARTITION BY Ticker ORDER BY d) AS INTEGER) AS step
  FROM (SELECT Ticker, unnest(generate_series(CAST(last + 1 AS TIMESTAMP),
          CAST(last + {2 * H + 7} AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM lastv) x
  WHERE isodow(d) <= 5) t WHERE step <= {H})""",
    """fc AS (SELECT bd.Ticker, Date, step, y0, slope, intercept,
  sum(pow(slope, step - 1)) OVER (PARTITION BY bd.Ticker ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS geo
  FROM bd JOIN lastv ON bd.Ticker = lastv.Ticker JOIN a1 ON bd.Ticker = a1.Ticker)"""], f"""
SELECT Ticker, Date, {q_sql('pow(slope, step) * y0 + intercept * geo')} AS ar1, y0 AS last_value FROM fc"""))
def q_forecast_table(spark, sf):
    walk = X.walk_bars(spark, sf)
    coef = ar1_fit(walk)
    last = walk.groupBy("Ticker").agg(F.max_by("adj_close", "Date").alias("y0"))
    bd = Ts.business_days(walk, H).join(last, "Ticker").join(coef, "Ticker")
    geo = F.sum(F.pow("slope", F.col("step") - 1)).over(
        Window.partitionBy("Ticker").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    bd = bd.withColumn("geo", geo)
    ar = bd.select(F.lit("ar1").alias("model"), "Ticker", "Date",
                   quantize(F.pow("slope", F.col("step")) * F.col("y0")
                            + F.col("intercept") * F.col("geo")).alias("yhat"))
    lv = bd.select(F.lit("last_value").alias("model"), "Ticker", "Date", F.col("y0").alias("yhat"))
    return Ts.forecast_table(ar.unionByName(lv), ["ar1", "last_value"])


# ------------------------------------------------------------ rows-only models
@register("adf")
def q_adf(spark, sf):
    bars = X.region_bars(spark, sf)
    a = Ts.adf_test(bars).withColumn("series", F.lit("bars"))
    b = Ts.adf_test(X.walk_bars(spark, sf, bars)).withColumn("series", F.lit("walk_bars"))
    return a.unionByName(b)


def _adf0_sql(src, name):
    return with_ctes(X.WALK_BARS_SQL + ["""lrw AS (SELECT Ticker, Date, lr AS adj_close FROM (
  SELECT Ticker, Date, ln(adj_close / lag(adj_close, 1) OVER (PARTITION BY Ticker ORDER BY Date)) AS lr FROM walk) x
  WHERE lr IS NOT NULL)"""] + _df_sql(src), f"""
SELECT Ticker, '{name}' AS series, n_obs, {q_sql("t_stat", 12)} AS adf_stat, t_stat < crit_5 AS stationary FROM dft""")


@register("adf_lag0", "SELECT * FROM (" + _adf0_sql("walk", "price") + ") a UNION ALL SELECT * FROM ("
          + _adf0_sql("lrw", "log_return") + ") b")
def q_adf_lag0(spark, sf):
    """The ADF machinery without lags, on prices and on log returns."""
    walk = X.walk_bars(spark, sf).select("Ticker", "Date", "adj_close")
    lr = F.ln(F.col("adj_close") / F.lag("adj_close", 1).over(by_key()))
    returns = walk.withColumn("adj_close", lr).filter(F.col("adj_close").isNotNull())
    parts = [Ts.adf_test(df, max_lag=0).select("Ticker", F.lit(name).alias("series"), "n_obs",
                                               quantize("adf_stat", 12).alias("adf_stat"), "stationary")
             for name, df in (("price", walk), ("log_return", returns))]
    return parts[0].unionByName(parts[1])


FORECASTS = ["arima", "seasonal", "window_regressor", "last_value"]


@register("forecast_models")
def q_forecast_models(spark, sf):
    return Ts.forecast_models(X.region_bars(spark, sf), H)


@register("forecast_csv")
def q_forecast_csv(spark, sf):
    """The forecasts written as sorted CSV, one folder a key, and read back."""
    from barwise.sources import files as Fi
    path = Fi.scratch_path(spark, f"forecast_{H}d")
    Fi.export_csv(Ts.forecast_models(X.region_bars(spark, sf), H), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("Ticker").cast("string").alias("Ticker"), F.col("Date").cast("date").alias("Date"),
                       *[F.col(m).cast("double").alias(m) for m in FORECASTS])


_AR1_PATH = ("y0 + c * step / (1 - f) - c / (1 - f) * f * (1 - pow(f, step)) / (1 - f)"
             " + d0 * f * (1 - pow(f, step)) / (1 - f)")


@register("forecast_ar1_diff", with_ctes(X.WALK_BARS_SQL + [f"""
w0 AS (SELECT Ticker, Date, Close AS y, Close - lag(Close, 1) OVER ({W}) AS dy FROM walk)""", f"""
w1 AS (SELECT *, lag(dy, 1) OVER ({W}) AS dl FROM w0)""", """
wc AS (SELECT Ticker, regr_slope(dy, dl) AS f, regr_intercept(dy, dl) AS c, arg_max(y, Date) AS y0, arg_max(dy, Date) AS d0,
  max(Date) AS last FROM w1 GROUP BY Ticker)""", f"""
wd AS (SELECT * FROM (SELECT Ticker, CAST(d AS DATE) AS Date, CAST(row_number() OVER (PARTITION BY Ticker ORDER BY d) AS INTEGER) AS step
  FROM (SELECT Ticker, unnest(generate_series(CAST(last + 1 AS TIMESTAMP), CAST(last + {2 * H + 7} AS TIMESTAMP), INTERVAL 1 DAY)) AS d
        FROM wc) x WHERE isodow(d) <= 5) t WHERE step <= {H})"""], f"""
SELECT Ticker, Date, {q_sql(_AR1_PATH, 12)} AS yhat FROM wd JOIN wc USING (Ticker)"""))
def q_forecast_ar1_diff(spark, sf):
    """AR(1) on differences: the recursion against its closed form."""
    return Ts.ar_future(X.walk_bars(spark, sf), H, p=1).select("Ticker", "Date", quantize("yhat", 12).alias("yhat"))


@register("seasonal_holidays")
def q_seasonal_holidays(spark, sf):
    """Research preset with a holiday dimension (the first and last trading day
    of every year in the bars)."""
    bars = X.region_bars(spark, sf)
    days = bars.groupBy(F.year("Date").alias("y")).agg(F.min("Date").alias("a"), F.max("Date").alias("b"))
    holidays = days.select(F.explode(F.array(F.struct(F.lit("first").alias("holiday"), F.col("a").alias("Date")),
                                             F.struct(F.lit("last").alias("holiday"), F.col("b").alias("Date")))).alias("h")).select("h.*")
    return Ts.seasonal_backtest(bars, price="Close", multiplicative=True, seasons=Ts.RESEARCH_SEASONS, holidays=holidays)


@register("ar_forecast")
def q_ar_forecast(spark, sf):
    return Ts.ar_backtest(X.walk_bars(spark, sf), p=5, price="Close")


@register("ar_order")
def q_ar_order(spark, sf):
    return Ts.ar_order_by_aic(X.walk_bars(spark, sf), max_p=5, price="Close")


@register("seasonal")
def q_seasonal(spark, sf):
    return Ts.seasonal_backtest(X.region_bars(spark, sf), price="Close", multiplicative=True)


# M13 with one season and no changepoints: trend and season are regressed on the
# level and slope first, the penalised remainder is a system of two equations
SEASON_ONE_CTES = X.REGION_BARS_SQL + [f"""
so AS (SELECT Ticker, Date, Close AS y, CAST(Date - min(Date) OVER (PARTITION BY Ticker) AS DOUBLE) AS t,
  row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY Ticker) * 0.8) AS train FROM bars)""", """
sc AS (SELECT *, sin(2 * pi() / 7 * t) AS s, cos(2 * pi() / 7 * t) AS c FROM so)""", """
sa AS (SELECT Ticker, regr_slope(y, t) AS yb, regr_intercept(y, t) AS ya, regr_slope(s, t) AS sb, regr_intercept(s, t) AS sa,
  regr_slope(c, t) AS cb, regr_intercept(c, t) AS ca FROM sc WHERE train GROUP BY Ticker)""", """
sr AS (SELECT Ticker, Date, train, y AS actual, ya + yb * t AS trend, y - ya - yb * t AS y, s - sa - sb * t AS s, c - ca - cb * t AS c
  FROM sc JOIN sa USING (Ticker))""", """
ss AS (SELECT Ticker, sum(s * s) + 1 AS ss, sum(c * c) + 1 AS cc, sum(s * c) AS sc, sum(s * y) AS sy, sum(c * y) AS cy
  FROM sr WHERE train GROUP BY Ticker)"""]
_SEASON_ONE = "trend + ((cc * sy - sc * cy) * s + (ss * cy - sc * sy) * c) / (ss * cc - sc * sc)"


@register("seasonal_one", with_ctes(SEASON_ONE_CTES, f"""
SELECT Ticker, Date, actual, {q_sql(_SEASON_ONE, 12)} AS predicted FROM sr JOIN ss USING (Ticker) WHERE NOT train"""))
def q_seasonal_one(spark, sf):
    """M13 with a weekly pair of terms only, against its normal equations."""
    out = Ts.seasonal_backtest(X.region_bars(spark, sf), price="Close", n_changepoints=0, seasons=[("weekly", 7.0, 1)])
    return out.select("Ticker", "Date", "actual", quantize("predicted", 12).alias("predicted"))


# M15 on one lag: a ridge slope over the centred sums
WINDOW_ONE_CTES = X.REGION_BARS_SQL + [f"""
wo AS (SELECT Ticker, Date, Close, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY Ticker) * 0.8) AS train
  FROM bars)""", """
wm AS (SELECT Ticker, min(Close) AS lo, max(Close) AS hi FROM wo WHERE train GROUP BY Ticker)""", f"""
wx AS (SELECT Ticker, Date, train, Close, lo, hi, (Close - lo) / (hi - lo) AS y,
  lag((Close - lo) / (hi - lo), 1) OVER ({W}) AS x FROM wo JOIN wm USING (Ticker))""", """
wb AS (SELECT Ticker, regr_sxy(y, x) / (regr_sxx(y, x) + 0.001) AS b, regr_avgx(y, x) AS mx, regr_avgy(y, x) AS my
  FROM wx WHERE train GROUP BY Ticker)"""]


@register("window_regressor_one", with_ctes(WINDOW_ONE_CTES, f"""
SELECT Ticker, Date, Close AS actual, {q_sql('(my + b * (x - mx)) * (hi - lo) + lo', 12)} AS predicted
FROM wx JOIN wb USING (Ticker) WHERE NOT train"""))
def q_window_regressor_one(spark, sf):
    """M15 with a lookback of one bar, against its closed form."""
    out = Ts.window_regressor_backtest(X.region_bars(spark, sf), lookback=1, price="Close")
    return out.select("Ticker", "Date", "actual", quantize("predicted", 12).alias("predicted"))


@register("window_regressor")
def q_window_regressor(spark, sf):
    return Ts.window_regressor_backtest(X.region_bars(spark, sf), price="Close")


@register("series_summary")
def q_series_summary(spark, sf):
    return Ts.series_summary(X.region_bars(spark, sf))


# ------------------------------------------------ M12 with innovations and seasons
ARMA11_CTES = X.REGION_BARS_SQL + [f"""
h0 AS (SELECT Ticker, Date, Close - lag(Close, 1) OVER ({W}) AS y FROM bars)""", f"""
h1 AS (SELECT Ticker, Date, y, lag(y, 1) OVER ({W}) AS yl FROM h0 WHERE y IS NOT NULL)""", """
ha AS (SELECT Ticker, regr_slope(y, yl) AS b, regr_intercept(y, yl) AS a FROM h1 GROUP BY Ticker)""", f"""
h2 AS (SELECT Ticker, Date, y, yl, lag(y - a - b * yl, 1) OVER ({W}) AS el FROM h1 JOIN ha USING (Ticker))""", """
hs AS (SELECT Ticker, count(*) AS n, avg(y) AS my, avg(yl) AS mx, avg(el) AS me, var_pop(yl) AS xx, var_pop(el) AS ee,
  covar_pop(yl, el) AS xe, covar_pop(y, yl) AS xy, covar_pop(y, el) AS ey FROM h2 WHERE el IS NOT NULL GROUP BY Ticker)""", """
hc AS (SELECT *, (xy * ee - ey * xe) / (xx * ee - xe * xe) AS phi, (ey * xx - xy * xe) / (xx * ee - xe * xe) AS theta FROM hs)"""]


def _differences(bars):
    dy = F.col("Close") - F.lag("Close", 1).over(by_key())
    return bars.select("Ticker", "Date", dy.alias("value")).filter(F.col("value").isNotNull())


@register("arma11", with_ctes(ARMA11_CTES, f"""
SELECT Ticker, n, {q_sql('my - phi * mx - theta * me', 16)} AS const, {q_sql('phi', 16)} AS phi, {q_sql('theta', 16)} AS theta FROM hc"""))
def q_arma11(spark, sf):
    """ARMA(1,1) of the differences, both regressions in closed form in SQL
    (innovations of an autoregression of one lag)."""
    fit = Ar.fit_arma(_differences(X.region_bars(spark, sf)), (1, 1, 0, 0), long_ar=1, search=False)
    return fit.select("Ticker", "n", quantize("const", 16).alias("const"), quantize(F.col("phi")[0], 16).alias("phi"),
                      quantize(F.col("theta")[0], 16).alias("theta"))


@register("arma_orders")
def q_arma_orders(spark, sf):
    """All 144 seasonal orders on the series that the unit-root test chose."""
    bars = X.walk_bars(spark, sf)
    series = Ts.chosen_series(bars, Ts.df_test(bars))
    return Ar.fit_arma(series).select("Ticker", "p", "q", "sp", "sq", "n", "sigma2", "aic", "is_best")


@register("arma_future")
def q_arma_future(spark, sf):
    return Ar.arma_future(X.walk_bars(spark, sf), H)


@register("arma_long_key")
def q_arma_long_key(spark, sf):
    """Order search over one key dealt in chunks."""
    bars = X.series_bars(spark, sf).select("Ticker", "Date", "Close")
    diffs = long_diff(bars, 3_000, "Close", "value").select("Ticker", "Date", "value").filter(F.col("value").isNotNull())
    return Ar.fit_arma(diffs, chunk_rows=3_000).select(
        "Ticker", "p", "q", "sp", "sq", "n", "sigma2", "aic", "is_best")
