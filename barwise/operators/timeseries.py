"""Time-series models as Spark jobs (M10-M13, M15) and forecast plumbing (K1-K3).

* Unit-root test (M10): Dickey-Fuller regression dy = a + g*y_lag [+ lagged dy].
  Lag 0 is pure ``regr_*`` aggregates; the AIC lag search uses per-key Gram
  sums (``lsq.grouped_gram``) and solves every candidate lag from sub-blocks.
* AR(p) on first differences (M12) and the Fourier/hinge trend model (M13) use
  the same Gram job; the lookback-window regressor (M15) too.
* Multi-step forecasts are recursive ``aggregate`` over ``sequence(1, h)`` in
  Spark SQL, carrying the lag window in a struct - no Python loop per step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.exprs import round_cols, yes_no
from barwise.functions.windows import by_key
from barwise.operators.lsq import grouped_gram, materialize_small, solve
from barwise.operators.splits import split_per_key

# ---------------------------------------------------------------- fixed values
# MacKinnon (2010), Table 2, constant, one variable: tau critical values as
# b0 + b1/n + b2/n^2 + b3/n^3.
CRIT_C = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) approximate p-value, constant, one variable.
TAU_MAX_C, TAU_MIN_C, TAU_STAR_C = 2.74, -18.83, -1.61
SMALLP_C = (2.1659, 1.4412, 0.038269)
LARGEP_C = (1.7339, 0.93202, -0.12745, -0.010368)


def crit_value(n, level: str) -> Column | float:
    b0, b1, b2, b3 = CRIT_C[level]
    if isinstance(n, (int, float)):
        return b0 + b1 / n + b2 / (n * n) + b3 / (n * n * n)
    nd = n.cast("double")
    return (F.lit(b0) + F.lit(b1) / nd + F.lit(b2) / (nd * nd) + F.lit(b3) / (nd * nd * nd))


def mackinnon_p(tau: float) -> float:
    if tau is None or not math.isfinite(tau):
        return float("nan")
    if tau > TAU_MAX_C:
        return 1.0
    if tau < TAU_MIN_C:
        return 0.0
    coef = SMALLP_C if tau <= TAU_STAR_C else LARGEP_C
    z = sum(c * tau ** i for i, c in enumerate(coef))
    return 0.5 * (1.0 + math.erf(z / math.sqrt(2.0)))


# ---------------------------------------------------------------- M10 lag 0
def df_test(df: DataFrame, price="adj_close", key="Ticker", date="Date") -> DataFrame:
    """Dickey-Fuller test with a constant and no lagged differences."""
    ylag = F.lag(F.col(price), 1).over(by_key(key, date))
    x = df.select(key, ylag.alias("_yl"), (F.col(price) - ylag).alias("_dy"))
    g = x.groupBy(key).agg(
        F.regr_count("_dy", "_yl").alias("n_obs"), F.regr_slope("_dy", "_yl").alias("gamma"),
        F.regr_sxx("_dy", "_yl").alias("_sxx"), F.regr_syy("_dy", "_yl").alias("_syy"),
        F.regr_sxy("_dy", "_yl").alias("_sxy"))
    ssr = F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")
    se = F.sqrt(F.try_divide(F.try_divide(ssr, F.col("n_obs") - 2), F.col("_sxx")))
    t = F.try_divide(F.col("gamma"), se)
    out = g.select(key, "n_obs", "gamma", t.alias("t_stat"),
                   *[crit_value(F.col("n_obs"), lv).alias(f"crit_{lv[:-1]}") for lv in CRIT_C])
    return out.withColumn("stationary", F.col("t_stat") < F.col("crit_5"))


def choose_series(test: DataFrame, key="Ticker") -> DataFrame:
    """Model the price when it is stationary at 5 %, else the log returns."""
    st = F.coalesce(F.col("stationary"), F.lit(False))
    return test.select(key, yes_no(st).alias("Price_Stationary"),
                       F.when(st, "price").otherwise("log_return").alias("Series_Used"))


# ---------------------------------------------------------------- M10 with lags
def _lagged_diffs(df, price, key, date, max_lags: int):
    w = by_key(key, date)
    x = df.withColumn("_yl", F.lag(F.col(price), 1).over(w)) \
          .withColumn("_dy", F.col(price) - F.col("_yl"))
    x = x.withColumns({f"_d{j}": F.lag("_dy", j).over(w) for j in range(1, max_lags + 1)})
    return x.withColumn("_one", F.lit(1.0)).withColumn("_rn", F.row_number().over(w))


def _adf_select(pdf: pd.DataFrame, L: int) -> pd.DataFrame:
    """Per key: AIC over lags 0..maxlag on the common sample."""
    out = []
    for _, r in pdf.iterrows():
        k_all = 2 + L
        xtx = np.asarray(r["xtx"]).reshape(k_all, k_all)
        xty = np.asarray(r["xty"])
        n = int(r["n"])
        best, best_aic = 0, np.inf
        for lag in range(0, int(r["maxlag"]) + 1):
            idx = list(range(2 + lag))
            beta, ssr, _ = solve(xtx[np.ix_(idx, idx)].ravel(), xty[idx], r["yty"], n)
            if ssr <= 0 or n <= 0:
                continue
            aic = n * (math.log(2 * math.pi) + math.log(ssr / n) + 1) + 2 * len(idx)
            if aic < best_aic - 1e-12:
                best, best_aic = lag, aic
        out.append((r["key"], best))
    return pd.DataFrame(out, columns=["key", "used_lag"])


def adf_test(df: DataFrame, price="adj_close", key="Ticker", date="Date",
             max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with AIC lag choice (statsmodels' defaults:
    maxlag = ceil(12 (n/100)^(1/4)); all lags fitted on one common sample, the
    chosen one refitted on its full sample). Returns statistic, p-value
    (MacKinnon 1994), critical values (MacKinnon 2010) and the 5 % decision."""
    df = materialize_small(df.select(key, date, price))
    n_key = F.count(F.col(price)).over(Window.partitionBy(key)) - 1
    base = df.withColumn("_nobs", n_key)
    ml = F.ceil(F.lit(12.0) * F.pow(F.col("_nobs") / F.lit(100.0), F.lit(0.25)))
    ml = F.least(ml, F.floor(F.col("_nobs") / 2) - 3).cast("int") if max_lag is None \
        else F.lit(max_lag)
    base = base.withColumn("_maxlag", F.greatest(ml, F.lit(0)))
    L = int(base.agg(F.max("_maxlag")).first()[0] or 0)
    x = _lagged_diffs(base, price, key, date, L)
    # zero-fill lags beyond a key's own maxlag so every key shares one layout
    x = x.withColumns({f"_d{j}": F.when(F.lit(j) <= F.col("_maxlag"), F.col(f"_d{j}"))
                       .otherwise(F.lit(0.0)) for j in range(1, L + 1)})
    cols = ["_one", "_yl"] + [f"_d{j}" for j in range(1, L + 1)]
    common = x.filter(F.col("_rn") > F.col("_maxlag") + 1)
    g1 = grouped_gram(common, key, cols, "_dy")
    mlk = base.groupBy(F.col(key).cast("string").alias("key")).agg(F.max("_maxlag").alias("maxlag"))
    sel = materialize_small(g1.join(mlk, "key").groupBy("key").applyInPandas(
        lambda p: _adf_select(p, L), "key string, used_lag int"))
    # refit with the chosen lag on its own sample
    y = x.join(sel.withColumnRenamed("key", key), key)
    y = y.withColumns({f"_d{j}": F.when(F.lit(j) <= F.col("used_lag"), F.col(f"_d{j}"))
                       .otherwise(F.lit(0.0)) for j in range(1, L + 1)})
    y = y.filter(F.col("_rn") > F.col("used_lag") + 1)
    g2 = grouped_gram(y, key, cols, "_dy").join(sel, "key")

    def fin(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            k_all = 2 + L
            idx = list(range(2 + int(r["used_lag"])))
            xtx = np.asarray(r["xtx"]).reshape(k_all, k_all)[np.ix_(idx, idx)]
            xty = np.asarray(r["xty"])[idx]
            beta, ssr, se = solve(xtx.ravel(), xty, r["yty"], int(r["n"]))
            t = float(beta[1] / se[1]) if se[1] and np.isfinite(se[1]) and se[1] > 0 else float("nan")
            n = int(r["n"])
            crit = {lv: crit_value(n, lv) for lv in CRIT_C}
            rows.append((r["key"], int(r["used_lag"]), n, t, mackinnon_p(t), crit["1%"],
                         crit["5%"], crit["10%"], bool(t < crit["5%"]) if np.isfinite(t) else False))
        return pd.DataFrame(rows, columns=["key", "used_lag", "n_obs", "adf_stat", "p_value",
                                           "crit_1", "crit_5", "crit_10", "stationary"])
    schema = ("key string, used_lag int, n_obs long, adf_stat double, p_value double, "
              "crit_1 double, crit_5 double, crit_10 double, stationary boolean")
    res = g2.groupBy("key").applyInPandas(fin, schema)
    return res.withColumnRenamed("key", key)


# ---------------------------------------------------------------- M12
def fit_ar(df: DataFrame, p: int = 5, price="Close", key="Ticker", date="Date") -> DataFrame:
    """AR(p) on first differences (ARIMA(p,1,0)) by least squares per key:
    (key, n, const, phi array[p])."""
    x = _lagged_diffs(df, price, key, date, p)
    cols = ["_one"] + [f"_d{j}" for j in range(1, p + 1)]
    g = grouped_gram(x, key, cols, "_dy")

    def fn(pdf):
        rows = []
        for _, r in pdf.iterrows():
            beta, ssr, _ = solve(np.asarray(r["xtx"]), np.asarray(r["xty"]), r["yty"], int(r["n"]))
            n = int(r["n"])
            aic = n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * len(beta)
            rows.append((r["key"], n, float(beta[0]), [float(b) for b in beta[1:]], aic))
        return pd.DataFrame(rows, columns=["key", "n", "const", "phi", "aic"])
    res = g.groupBy("key").applyInPandas(
        fn, "key string, n long, const double, phi array<double>, aic double")
    return materialize_small(res.withColumnRenamed("key", key))


def ar_order_by_aic(df: DataFrame, max_p: int = 5, price="Close", key="Ticker", date="Date"):
    """Order search: AIC of AR(1..max_p) on first differences per key; the best
    order is flagged. All orders share the rows that have ``max_p`` lags, and one
    Gram job: order p is the leading sub-block."""
    x = _lagged_diffs(materialize_small(df.select(key, date, price)), price, key, date, max_p)
    return _orders(x, "_dy", [f"_d{j}" for j in range(1, max_p + 1)], key)


def ar_orders_on_levels(df: DataFrame, max_p: int = 5, value="value", key="Ticker", date="Date"):
    """``ar_order_by_aic`` without differencing: AR(1..max_p) of a series that is
    modelled as it is."""
    lags = {f"_l{j}": F.lag(F.col(value), j).over(by_key(key, date)) for j in range(1, max_p + 1)}
    x = materialize_small(df.select(key, date, value)).withColumns(lags).withColumn("_one", F.lit(1.0))
    return _orders(x, value, list(lags), key)


def _orders(x: DataFrame, y: str, lags: list[str], key: str) -> DataFrame:
    k = len(lags) + 1

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            xtx, xty, n = np.asarray(r["xtx"]).reshape(k, k), np.asarray(r["xty"]), int(r["n"])
            for p in range(1, k):
                _, ssr, _ = solve(xtx[:p + 1, :p + 1].ravel(), xty[:p + 1], r["yty"], n)
                aic = n * (math.log(2 * math.pi) + math.log(max(ssr, 1e-300) / n) + 1) + 2 * (p + 1)
                rows.append((r["key"], p, aic))
        return pd.DataFrame(rows, columns=["key", "p", "aic"])
    fits = grouped_gram(x, key, ["_one", *lags], y).groupBy("key").applyInPandas(fn, "key string, p int, aic double")
    fits = materialize_small(fits.withColumnRenamed("key", key))
    best = F.row_number().over(Window.partitionBy(key).orderBy("aic", "p")) == 1
    return fits.withColumn("is_best", best)


def recursive_forecast(state: Column, coef: Column, const: Column, h: Column) -> Column:
    """Array of h forecasts of y_t = const + sum(coef_i * window_i), where the
    window holds the latest value first and takes each forecast in front."""
    p_len = F.size(state)

    def step(acc, _i):
        nxt = const + F.aggregate(F.zip_with(acc["w"], coef, lambda a, b: a * b),
                                  F.lit(0.0), lambda s, v: s + v)
        return F.struct(F.concat(F.array(nxt), F.slice(acc["w"], 1, p_len - 1)).alias("w"),
                        F.concat(acc["o"], F.array(nxt)).alias("o"))
    init = F.struct(state.alias("w"), F.array().cast("array<double>").alias("o"))
    return F.aggregate(F.sequence(F.lit(1), h), init, step)["o"]


def ar_backtest(df: DataFrame, p: int = 5, price="Close", frac: float = 0.8, key="Ticker",
                date="Date", model="ar5_d1") -> DataFrame:
    """Honest ARIMA(p,1,0) backtest (quirk Q11): fit on the first 80 % of each
    key, forecast the rest from the end of the train part, undo differencing."""
    df = materialize_small(df.select(key, date, price))
    s = split_per_key(df, frac, key, date)
    train = s.filter(F.col("split") == "train")
    test = s.filter(F.col("split") == "test")
    coef = fit_ar(train, p, price, key, date)
    x = _lagged_diffs(train, price, key, date, p)
    last = x.groupBy(key).agg(F.max_by(F.struct(F.col(price).alias("lvl"), F.array(
        "_dy", *[f"_d{j}" for j in range(1, p)]).alias("w")), date).alias("s"))
    tw = Window.partitionBy(key).orderBy(date)
    test = test.withColumn("step", F.row_number().over(tw))
    h = test.groupBy(key).agg(F.max("step").alias("h"))
    plan = last.join(coef, key).join(h, key)
    fc = plan.select(key, F.col("s.lvl").alias("lvl"), F.posexplode(
        recursive_forecast(F.col("s.w"), F.col("phi"), F.col("const"), F.col("h"))).alias("pos", "dyhat"))
    cum = F.sum("dyhat").over(Window.partitionBy(key).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0))
    fc = fc.select(key, (F.col("pos") + 1).alias("step"), (F.col("lvl") + cum).alias("predicted"))
    return test.join(fc, [key, "step"]).select(
        F.lit(model).alias("model"), key, date, F.col(price).alias("actual"), "predicted")


def ar_future(df: DataFrame, n: int = 30, p: int = 5, price="Close", key="Ticker", date="Date",
              model="arima") -> DataFrame:
    """ARIMA(p,1,0) fitted on all bars, over the next ``n`` business days:
    (model, key, Date, yhat)."""
    df = materialize_small(df.select(key, date, price))
    coef = fit_ar(df, p, price, key, date)
    x = _lagged_diffs(df, price, key, date, p)
    last = x.groupBy(key).agg(F.max_by(F.struct(F.col(price).alias("lvl"), F.array(
        "_dy", *[f"_d{j}" for j in range(1, p)]).alias("w")), date).alias("s"))
    fc = last.join(coef, key).select(key, F.col("s.lvl").alias("lvl"), F.posexplode(recursive_forecast(
        F.col("s.w"), F.col("phi"), F.col("const"), F.lit(n))).alias("pos", "dyhat"))
    cum = F.sum("dyhat").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    fc = fc.select(key, (F.col("pos") + 1).alias("step"), (F.col("lvl") + cum).alias("yhat"))
    return business_days(df, n, key, date).join(fc, [key, "step"]).select(F.lit(model).alias("model"), key, date, "yhat")


# ---------------------------------------------------------------- M13
#: research preset: yearly and weekly terms only
RESEARCH_SEASONS = [("yearly", 365.25, 10), ("weekly", 7.0, 3)]
SEASONS = [("yearly", 365.25, 10), ("weekly", 7.0, 3), ("monthly", 30.5, 5)]


def _seasonal_design(df, key, date, n_changepoints, seasons):
    w = Window.partitionBy(key)
    d0 = F.min(date).over(w)
    train_end = F.max(F.when(F.col("split") == "train", F.col(date))).over(w)
    span = F.greatest(F.datediff(train_end, d0), F.lit(1)).cast("double")
    days = F.datediff(F.col(date), d0).cast("double")
    x = df.withColumn("_t", days / span).withColumn("_days", days)
    cols = {"_one": F.lit(1.0), "_tt": F.col("_t")}
    for j in range(1, n_changepoints + 1):
        c = 0.8 * j / (n_changepoints + 1)
        cols[f"_cp{j}"] = F.greatest(F.col("_t") - F.lit(c), F.lit(0.0))
    for name, period, order in seasons:
        for k in range(1, order + 1):
            ang = F.lit(2.0 * math.pi * k / period) * F.col("_days")
            cols[f"_{name}_s{k}"] = F.sin(ang)
            cols[f"_{name}_c{k}"] = F.cos(ang)
    return x.withColumns(cols), list(cols)


def seasonal_backtest(df: DataFrame, price="Close", key="Ticker", date="Date", frac=0.8,
                      n_changepoints: int = 25, seasons=SEASONS, multiplicative=False,
                      ridge: float = 1.0, model="seasonal", holidays: DataFrame | None = None) -> DataFrame:
    """Trend + Fourier seasonality regression per key (M13, point forecasts):
    piecewise-linear trend with hinges in the first 80 % of the train span,
    sin/cos terms per season; ridge on everything but level and slope; fit on
    the train part, predict the test part. ``multiplicative`` fits ln(price).
    ``holidays`` (holiday, Date): one 0/1 term per holiday name (a dimension of a
    few names; its dates are joined, its names read)."""
    df = materialize_small(df.select(key, date, price))
    s = split_per_key(df, frac, key, date)
    t = _seasonal_predict(s, "test", price, key, date, n_changepoints, seasons, multiplicative, ridge, holidays)
    return t.select(F.lit(model).alias("model"), key, date, F.col(price).alias("actual"), "predicted")


def seasonal_forecast(df: DataFrame, n: int = 30, price="Close", key="Ticker", date="Date",
                      n_changepoints: int = 25, seasons=SEASONS, multiplicative=False, ridge: float = 1.0,
                      model="seasonal", holidays: DataFrame | None = None) -> DataFrame:
    """The seasonal model fitted on all bars, on the next ``n`` business days:
    (model, key, Date, yhat)."""
    df = materialize_small(df.select(key, date, price))
    days = business_days(df, n, key, date).select(key, date, F.lit(None).cast("double").alias(price))
    both = df.withColumn("split", F.lit("train")).unionByName(days.withColumn("split", F.lit("future")))
    t = _seasonal_predict(both, "future", price, key, date, n_changepoints, seasons, multiplicative, ridge, holidays)
    return t.select(F.lit(model).alias("model"), key, date, F.col("predicted").alias("yhat"))


def _seasonal_predict(s, part, price, key, date, n_changepoints, seasons, multiplicative, ridge, holidays):
    """Rows of ``part`` with ``predicted``, fitted on the train rows."""
    x, cols = _seasonal_design(s, key, date, n_changepoints, seasons)
    if holidays is not None:
        names = sorted(r[0] for r in holidays.select("holiday").distinct().collect())
        flags = holidays.groupBy(F.col("Date").alias(date)).pivot("holiday", names).agg(F.lit(1.0))
        flags = flags.select(date, *[F.col(f"`{h}`").alias(f"_h{i}") for i, h in enumerate(names)])
        x = x.join(flags, date, "left").na.fill(0.0, [f"_h{i}" for i in range(len(names))])
        cols += [f"_h{i}" for i in range(len(names))]
    y = F.ln(F.col(price)) if multiplicative else F.col(price)
    x = x.withColumn("_y", y)
    g = grouped_gram(x.filter(F.col("split") == "train"), key, cols, "_y")
    pen = np.array([0.0, 0.0] + [1.0] * (len(cols) - 2))

    def fn(pdf):
        rows = []
        for _, r in pdf.iterrows():
            beta, _, _ = solve(np.asarray(r["xtx"]), np.asarray(r["xty"]), r["yty"], int(r["n"]),
                               ridge=ridge, penalize=pen)
            rows.append((r["key"], [float(b) for b in beta]))
        return pd.DataFrame(rows, columns=["key", "beta"])
    coef = materialize_small(g.groupBy("key").applyInPandas(fn, "key string, beta array<double>")
                             .withColumnRenamed("key", key))
    yhat = _dot(cols, F.col("beta"), F.lit(0.0))
    return x.filter(F.col("split") == part).join(coef, key).withColumn(
        "predicted", F.exp(yhat) if multiplicative else yhat)


# ---------------------------------------------------------------- M15
def _fit_window_regressor(s: DataFrame, lookback: int, price: str, key: str, date: str, ridge: float):
    """Scaled lags per row, their names (latest first) and the coefficients per
    key, fitted on the train rows of ``s``."""
    from barwise.operators.splits import minmax
    s = minmax(s, price, "train", key=key, name="_xs")
    w = by_key(key, date)
    lagc = {f"_l{j}": F.lag("_xs", j).over(w) for j in range(1, lookback + 1)}
    x = s.withColumns(lagc).withColumn("_one", F.lit(1.0))
    cols = ["_one"] + list(lagc)
    g = grouped_gram(x.filter(F.col("split") == "train"), key, cols, "_xs")
    pen = np.array([0.0] + [1.0] * lookback)

    def fn(pdf):
        rows = []
        for _, r in pdf.iterrows():
            beta, _, _ = solve(np.asarray(r["xtx"]), np.asarray(r["xty"]), r["yty"], int(r["n"]),
                               ridge=ridge, penalize=pen)
            rows.append((r["key"], float(beta[0]), [float(b) for b in beta[1:]]))
        return pd.DataFrame(rows, columns=["key", "const", "coef"])
    coef = materialize_small(g.groupBy("key").applyInPandas(
        fn, "key string, const double, coef array<double>").withColumnRenamed("key", key))
    return x, list(lagc), coef


def _dot(cols, coef, const):
    return const + F.aggregate(F.zip_with(F.array(*cols), coef, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def window_regressor_backtest(df: DataFrame, lookback: int = 90, price="Close", key="Ticker",
                              date="Date", frac=0.8, ridge: float = 1e-3,
                              model="window_regressor") -> DataFrame:
    """Lookback-window regressor (re-aim of the recurrent nets): per-key
    min-max scaling fitted on train, ridge on the previous ``lookback`` scaled
    values. Each test bar is predicted one step ahead from the true window
    before it."""
    s = split_per_key(materialize_small(df.select(key, date, price)), frac, key, date)
    x, lags, coef = _fit_window_regressor(s, lookback, price, key, date, ridge)
    ys = _dot(lags, F.col("coef"), F.col("const"))
    back = ys * (F.col(f"{price}_max") - F.col(f"{price}_min")) + F.col(f"{price}_min")
    return x.filter(F.col("split") == "test").join(coef, key).select(
        F.lit(model).alias("model"), key, date, F.col(price).alias("actual"), back.alias("predicted"))


def window_regressor_forecast(df: DataFrame, n: int = 30, lookback: int = 90, price="Close", key="Ticker",
                              date="Date", ridge: float = 1e-3, model="window_regressor") -> DataFrame:
    """The lookback model fitted on all bars and fed its own predictions over the
    next ``n`` business days: (model, key, Date, yhat)."""
    df = materialize_small(df.select(key, date, price))
    x, lags, coef = _fit_window_regressor(df.withColumn("split", F.lit("train")), lookback, price, key, date, ridge)
    state = F.array("_xs", *lags[:-1])
    last = x.groupBy(key).agg(F.max_by(F.struct(state.alias("w"), F.col(f"{price}_min").alias("lo"),
                                                F.col(f"{price}_max").alias("hi")), date).alias("s"))
    fc = last.join(coef, key).select(key, "s.lo", "s.hi", F.posexplode(recursive_forecast(
        F.col("s.w"), F.col("coef"), F.col("const"), F.lit(n))).alias("pos", "ys"))
    fc = fc.select(key, (F.col("pos") + 1).alias("step"), (F.col("ys") * (F.col("hi") - F.col("lo")) + F.col("lo")).alias("yhat"))
    return business_days(df, n, key, date).join(fc, [key, "step"]).select(F.lit(model).alias("model"), key, date, "yhat")


# ---------------------------------------------------------------- K1-K3
def business_days(df: DataFrame, n: int = 30, key="Ticker", date="Date") -> DataFrame:
    """K1: the next n Monday-Friday dates after each key's last bar (no holidays)."""
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    days = last.select(key, F.explode(F.sequence(F.date_add("_last", 1),
                                                 F.date_add("_last", 2 * n + 7))).alias(date))
    days = days.filter(F.weekday(date) < 5)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(date))
    return days.withColumn("step", rn).filter(F.col("step") <= n)


def calendar_days(df: DataFrame, n: int = 60, key="Ticker", date="Date") -> DataFrame:
    """K2: the next n calendar days."""
    last = df.groupBy(key).agg(F.max(date).alias("_last"))
    return last.select(key, F.posexplode(F.sequence(F.date_add("_last", 1),
                                                    F.date_add("_last", n))).alias("step", date)) \
               .withColumn("step", F.col("step") + 1)


def forecast_table(forecasts: DataFrame, models: list[str], key="Ticker", date="Date",
                   value="yhat") -> DataFrame:
    """K3: wide table (key, Date, one column per model)."""
    return forecasts.groupBy(key, date).pivot("model", models).agg(F.first(value))


def forecast_models(df: DataFrame, n: int = 30, price="Close", key="Ticker", date="Date", decimals: int = 2,
                    lookback: int = 90) -> DataFrame:
    """Wide table of the next ``n`` business days of every key: arima, seasonal,
    window_regressor (fed its own predictions) and last_value, rounded."""
    bars = materialize_small(df.select(key, date, price))
    last = bars.groupBy(key).agg(F.max_by(price, date).alias("yhat"))
    flat = business_days(bars, n, key, date).join(last, key).select(F.lit("last_value").alias("model"), key, date, "yhat")
    models = ["arima", "seasonal", "window_regressor", "last_value"]
    long = (ar_future(bars, n, 5, price, key, date).unionByName(seasonal_forecast(bars, n, price, key, date))
            .unionByName(window_regressor_forecast(bars, n, lookback, price, key, date)).unionByName(flat))
    return round_cols(forecast_table(long, models, key, date), {m: decimals for m in models})


# ---------------------------------------------------------------- E7
def chosen_series(df: DataFrame, test: DataFrame, price="adj_close", key="Ticker", date="Date") -> DataFrame:
    """(key, date, value): the price of keys whose price is stationary by
    ``test``, the log returns of the others."""
    log_return = F.ln(F.try_divide(F.col(price), F.lag(price, 1).over(by_key(key, date))))
    x = df.select(key, date, F.col(price).alias("_price"), log_return.alias("_lr"))
    used = choose_series(test, key).select(key, "Series_Used")
    value = F.when(F.col("Series_Used") == "price", F.col("_price")).otherwise(F.col("_lr"))
    return x.join(used, key).select(key, date, value.alias("value")).filter(F.col("value").isNotNull())


def series_summary(df: DataFrame, price="adj_close", key="Ticker", date="Date", p: int = 5):
    """Per key - is the price stationary (ADF p < 5 %), which series is
    modelled, the ADF p-values of price and log returns, the best AIC of an AR
    order search on the series modelled, and the research trend model's test
    MAPE %."""
    from barwise.operators.metrics import regression_metrics
    df = materialize_small(df.select(key, date, price))
    test = materialize_small(adf_test(df, price, key, date).withColumn("stationary", F.col("p_value") < 0.05))
    adf = choose_series(test, key).join(test.select(key, F.col("p_value").alias("Price_p_value")), key)
    returns = df.withColumn("_lr", F.ln(F.try_divide(F.col(price), F.lag(price, 1).over(by_key(key, date)))))
    adf_lr = adf_test(returns.filter(F.col("_lr").isNotNull()), "_lr", key, date).select(
        key, F.col("p_value").alias("LogReturn_p_value"))
    ar = ar_orders_on_levels(chosen_series(df, test, price, key, date), p, "value", key, date).filter("is_best").select(
        key, F.col("p").alias("AR_Order"), F.col("aic").alias("AR_AIC"))
    adf = adf.join(adf_lr, key)
    mape = regression_metrics(seasonal_backtest(df, price, key, date, seasons=RESEARCH_SEASONS,
                                                multiplicative=True), by=(key,)).select(
        key, F.col("mape_pct").alias("Seasonal_MAPE_pct"))
    return adf.join(ar, key).join(mape, key)
