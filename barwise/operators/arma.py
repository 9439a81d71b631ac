"""ARMA models with seasonal lags by two regressions (M12, Hannan-Rissanen).

Stage one fits a long autoregression; its residuals stand for the innovations.
Stage two regresses the value on its own lags and on lagged innovations. Both
stages are Gram sums per key, and since all orders share one sample, every
(p, q, P, Q) is a sub-block of one Gram matrix: the whole order search is one
pass. Seasonal orders add the lags season, 2 * season, ... of values (P) and
innovations (Q). A forecast carries the last values and innovations on, future
innovations being zero.

With ``chunk_rows`` the lags are taken over chunks with a halo instead of whole
keys (``long_keys``), so a key of any length is dealt to many tasks.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.long_keys import cut_keys
from barwise.functions.windows import by_key
from barwise.operators.lsq import aic, grouped_gram, materialize_small, solve_scaled

#: largest p, q, P, Q of the order search and the length of a season
ORDERS, SEASON = (3, 3, 2, 2), 5
LONG_AR = 20

FIT = ("key string, p int, q int, sp int, sq int, n long, const double, ar_lags array<int>, phi array<double>, "
       "ma_lags array<int>, theta array<double>, sigma2 double, aic double")


def lag_sets(orders: tuple[int, int, int, int], season: int) -> tuple[list[int], list[int]]:
    """Lags of values and of innovations of an order (p, q, P, Q)."""
    p, q, sp, sq = orders
    return (sorted({*range(1, p + 1), *(season * j for j in range(1, sp + 1))}),
            sorted({*range(1, q + 1), *(season * j for j in range(1, sq + 1))}))


def innovations(df: DataFrame, value: str, long_ar: int, most: int, key="Ticker", date="Date",
                chunk_rows: int | None = None) -> tuple[DataFrame, list, DataFrame]:
    """Stage one. (rows with ``_y`` (value less the key's mean), ``_e`` (residual
    of the long autoregression, null without all its lags) and ``_own``, the
    columns that windows partition by, the key's means)."""
    df = materialize_small(df.select(key, date, value))
    means = df.groupBy(key).agg(F.avg(value).alias("_mean"))
    part = [key]
    if chunk_rows:
        # what a key has is joined to its chunks: a join by key alone is one task for a long key
        cut = cut_keys(df.filter(F.col(key).isNotNull()), long_ar + most, 0, chunk_rows, key, date)
        part, chunks = [key, "_chunk"], materialize_small(cut.select(key, "_chunk").distinct())
        x = cut.join(chunks.join(means, key), part).select(key, date, (F.col(value) - F.col("_mean")).alias("_y"), "_chunk", "_own")
    else:
        x = df.join(means, key).select(key, date, (F.col(value) - F.col("_mean")).alias("_y")).withColumn("_own", F.lit(True))
    lags = [f"_l{j}" for j in range(1, long_ar + 1)]
    x = x.withColumns({c: F.lag("_y", j + 1).over(by_key(part, date)) for j, c in enumerate(lags)}).withColumn("_one", F.lit(1.0))
    gram = grouped_gram(x.filter("_own"), key, ["_one", *lags], "_y")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(r.key, solve_scaled(np.asarray(r.xtx), np.asarray(r.xty), r.yty)[0].tolist())
                             for r in pdf.itertuples()], columns=["_k", "_beta"])

    coef = materialize_small(gram.groupBy("key").applyInPandas(fit, "_k string, _beta array<double>"))
    if chunk_rows:
        x = x.join(chunks.join(coef, F.col(key).cast("string") == F.col("_k")), part)
    else:
        x = x.join(coef, F.col(key).cast("string") == F.col("_k"))
    terms = F.zip_with(F.array("_one", *lags), "_beta", lambda a, b: a * b)
    e = F.when(F.col(lags[-1]).isNotNull(), F.col("_y") - F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    return x.withColumn("_e", e).drop("_k", "_beta", "_one", *lags), part, means


def fit_arma(df: DataFrame, orders: tuple[int, int, int, int] = ORDERS, season: int = SEASON, long_ar: int = LONG_AR,
             value="value", key="Ticker", date="Date", chunk_rows: int | None = None, search: bool = True) -> DataFrame:
    """One row per key and order (p, q, sp, sq) up to ``orders`` (``search`` off:
    that order alone): coefficients by lag, innovation variance, AIC on the rows
    that have all lags of the largest order, and ``is_best`` (least AIC, then
    fewest terms). Rows need a value; gaps are not interpolated."""
    ar, ma = lag_sets(orders, season)
    most = max([*ar, *ma, 1])
    x, part, means = innovations(df, value, long_ar, most, key, date, chunk_rows)
    w = by_key(part, date)
    cols = {**{f"_a{j}": F.lag("_y", j).over(w) for j in ar}, **{f"_m{j}": F.lag("_e", j).over(w) for j in ma}}
    # the common sample starts where the largest order has all its innovations
    x = x.withColumns(cols).withColumn("_one", F.lit(1.0)).withColumn("_start", F.lag("_e", most).over(w))
    gram = grouped_gram(x.filter(F.col("_own") & F.col("_start").isNotNull()), key, ["_one", *cols], "_y")
    place = {c: i + 1 for i, c in enumerate(cols)}
    k = len(cols) + 1
    tried = list(product(*(range(o + 1) for o in orders))) if search else [orders]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            xtx, xty, n = np.asarray(r.xtx).reshape(k, k), np.asarray(r.xty), int(r.n)
            for order in tried:
                own_ar, own_ma = lag_sets(order, season)
                at = [0, *(place[f"_a{j}"] for j in own_ar), *(place[f"_m{j}"] for j in own_ma)]
                beta, ssr = solve_scaled(xtx[np.ix_(at, at)], xty[at], r.yty)
                phi, theta = beta[1:1 + len(own_ar)], beta[1 + len(own_ar):]
                rows.append((r.key, *order, n, float(beta[0]), own_ar, phi.tolist(), own_ma, theta.tolist(),
                             ssr / n, aic(n, ssr, len(at))))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FIT.split(", ")])

    fits = gram.groupBy("key").applyInPandas(fit, FIT)
    # the mean was taken off the values: its share of the constant comes back
    shift = F.col("_mean") * (F.lit(1.0) - F.aggregate("phi", F.lit(0.0), lambda s, v: s + v))
    fits = (fits.join(means.withColumn("_k", F.col(key).cast("string")), F.col("key") == F.col("_k"))
            .withColumn("const", F.col("const") + shift).select(key, *[c.split()[0] for c in FIT.split(", ")[1:]]))
    fits = materialize_small(fits)
    terms = F.size("ar_lags") + F.size("ma_lags")
    best = F.row_number().over(Window.partitionBy(key).orderBy("aic", terms, "p", "q", "sp", "sq"))
    return fits.withColumn("is_best", best == 1)


def last_states(df: DataFrame, most: int, value="value", long_ar: int = LONG_AR, key="Ticker", date="Date",
                chunk_rows: int | None = None) -> DataFrame:
    """(key, ys, es): the last ``most`` values and innovations of each key, latest first."""
    x, part, means = innovations(df, value, long_ar, most, key, date, chunk_rows)
    w = by_key(part, date)
    lagged = lambda c: F.array(F.col(c), *[F.lag(c, j).over(w) for j in range(1, most)])
    x = x.withColumn("_s", F.struct(lagged("_y").alias("ys"), lagged("_e").alias("es"))).filter("_own")
    last = x.groupBy(key).agg(F.max_by("_s", date).alias("_s")).join(means, key)
    return last.select(key, F.transform("_s.ys", lambda v: v + F.col("_mean")).alias("ys"),
                       F.transform("_s.es", lambda v: F.coalesce(v, F.lit(0.0))).alias("es"))


def arma_path(steps) -> F.Column:
    """Array of ``steps`` forecasts from the columns ys, es, const, ar_lags, phi,
    ma_lags, theta: each is pushed before the values, a zero before the innovations."""
    def part(lags, coefs, window):
        return F.aggregate(F.zip_with(lags, coefs, lambda j, c: c * F.element_at(window, j)), F.lit(0.0), lambda s, v: s + v)

    def step(acc, _):
        y = F.col("const") + part(F.col("ar_lags"), F.col("phi"), acc["y"]) + part(F.col("ma_lags"), F.col("theta"), acc["e"])
        push = lambda v, a: F.concat(F.array(v), F.slice(a, 1, F.size(a) - 1))
        return F.struct(push(y, acc["y"]).alias("y"), push(F.lit(0.0), acc["e"]).alias("e"), F.concat(acc["o"], F.array(y)).alias("o"))

    start = F.struct(F.col("ys").alias("y"), F.col("es").alias("e"), F.array().cast("array<double>").alias("o"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["o"]


def arma_forecast(df: DataFrame, n: int = 30, orders: tuple[int, int, int, int] = ORDERS, season: int = SEASON,
                  long_ar: int = LONG_AR, value="value", key="Ticker", date="Date", chunk_rows: int | None = None,
                  search: bool = True) -> DataFrame:
    """(key, step, yhat): ``n`` steps ahead with the order of least AIC of each key."""
    df = materialize_small(df.select(key, date, value))
    most = max([*lag_sets(orders, season)[0], *lag_sets(orders, season)[1], 1])
    best = fit_arma(df, orders, season, long_ar, value, key, date, chunk_rows, search).filter("is_best")
    state = last_states(df, most, value, long_ar, key, date, chunk_rows)
    return state.join(best, key).select(key, F.posexplode(arma_path(n)).alias("step", "yhat")).withColumn("step", F.col("step") + 1)


def arma_future(df: DataFrame, n: int = 30, price="Close", key="Ticker", date="Date", model="sarima", **kw) -> DataFrame:
    """ARMA of the first differences, summed up to levels, over the next ``n``
    business days: (model, key, Date, yhat)."""
    from barwise.operators.timeseries import business_days
    df = materialize_small(df.select(key, date, price))
    diffs = df.select(key, date, (F.col(price) - F.lag(price, 1).over(by_key(key, date))).alias("value")).filter("value IS NOT NULL")
    steps = arma_forecast(diffs, n, key=key, date=date, **kw)
    last = df.groupBy(key).agg(F.max_by(price, date).alias("_level"))
    up = F.sum("yhat").over(Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    path = steps.withColumn("_up", up).join(last, key).select(key, "step", (F.col("_level") + F.col("_up")).alias("yhat"))
    return business_days(df, n, key, date).join(path, [key, "step"]).select(F.lit(model).alias("model"), key, date, "yhat")
