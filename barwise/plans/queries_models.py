"""Registered queries (rows-only): supervised models on the engineered panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions.exprs import quantize
from barwise.operators import models as Mo
from barwise.plans.queries_eval import CUT_CTES, ml_frame
from barwise.plans.queries_features import PANEL_CTES
from barwise.plans.registry import REGISTRY, q_sql, register, with_ctes
from barwise.sources import fixtures as X


def _design(spark, sf):
    return Mo.design(ml_frame(spark, sf))


def _reg(name, **kw):
    def q(spark, sf):
        return Mo.backtest(_design(spark, sf), name, **kw)
    q.__name__ = f"q_{name}"
    return q


for _name in ["linear", "ridge", "lasso", "gbt_leafwise", "gbt_depthwise", "forest"]:
    REGISTRY[_name] = (_reg(_name), None)


def q_direction(spark, sf):
    return Mo.direction_backtest(ml_frame(spark, sf))


def q_direction_accuracy(spark, sf):
    from barwise.operators.metrics import accuracy
    return accuracy(q_direction(spark, sf))


REGISTRY["direction"] = (q_direction, None)
REGISTRY["direction_accuracy"] = (q_direction_accuracy, None)


# ------------------------------------------------ SQL twins of what SQL can say
@register("model_test_rows", with_ctes(PANEL_CTES + CUT_CTES, """
SELECT Ticker, Date, Target_Next_Price AS actual FROM sp WHERE split = 'test'"""))
def q_model_test_rows(spark, sf):
    """The rows that every model on the panel is scored on."""
    return _design(spark, sf).filter("split = 'test'").select("Ticker", "Date", F.col("label").alias("actual"))


@register("linear_one", with_ctes(PANEL_CTES + CUT_CTES + ["""
lo AS (SELECT regr_slope(Target_Next_Price, adj_close) AS b, regr_intercept(Target_Next_Price, adj_close) AS a
  FROM sp WHERE split = 'train')"""], f"""
SELECT Ticker, Date, {q_sql('a + b * adj_close', 12)} AS predicted FROM sp, lo WHERE split = 'test'"""))
def q_linear_one(spark, sf):
    """M1 on one standardised feature: the closed form is a simple regression."""
    ml = ml_frame(spark, sf, ["Ticker", "Date", "adj_close", "Target_Next_Price"])
    out = Mo.backtest(Mo.design(ml, ("adj_close",)), "linear")
    return out.select("Ticker", "Date", quantize("predicted", 12).alias("predicted"))


def _one_feature(name, **kw):
    def q(spark, sf):
        ml = ml_frame(spark, sf, ["Ticker", "Date", "adj_close", "Target_Next_Price"])
        out = Mo.backtest(Mo.design(ml, ("adj_close",)), name, **kw)
        return out.select("Ticker", "Date", quantize("predicted", 12).alias("predicted"))
    return q


#: least squares on one standardised feature: mean, deviation and covariance say all
_ONE = PANEL_CTES + CUT_CTES + ["""
oc AS (SELECT avg(adj_close) AS m, stddev_pop(adj_close) AS s, avg(Target_Next_Price) AS my, count(*) AS n,
  covar_pop(Target_Next_Price, adj_close) / stddev_pop(adj_close) AS c FROM sp WHERE split = 'train')"""]
_ONE_OUT = "SELECT Ticker, Date, {} AS predicted FROM sp, oc WHERE split = 'test'"
LASSO_ONE_ALPHA = 0.01

# M2: the penalty 1 against the n of a standardised feature; M3: the soft threshold
REGISTRY["ridge_one"] = (_one_feature("ridge"), with_ctes(_ONE, _ONE_OUT.format(
    q_sql("my + c * n / (n + 1) * (adj_close - m) / s", 12))))
REGISTRY["lasso_one"] = (_one_feature("lasso", alpha=LASSO_ONE_ALPHA), with_ctes(_ONE, _ONE_OUT.format(
    q_sql(f"my + sign(c) * greatest(abs(c) - {LASSO_ONE_ALPHA}, 0) * (adj_close - m) / s", 12))))


# ------------------------------------------------ dashboard: models on 20 lags
def lag_design(spark, sf, n_lags: int = 20):
    """F14 lag matrix on Close, per-key 80/20 split by position."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from barwise.functions.windows import lag_matrix
    from barwise.operators.lsq import materialize_small, spread
    from barwise.operators.splits import split_per_key
    from barwise.sources import fixtures as X
    lm = split_per_key(lag_matrix(X.region_bars(spark, sf), "Close", n_lags), 0.8)
    cols = [f"lag_{k}" for k in range(1, n_lags + 1)]
    out = VectorAssembler(inputCols=cols, outputCol="features").transform(lm)
    return materialize_small(spread(out.select("Ticker", "Date", "split",
                                               F.col("target").alias("label"), "features")))


@register("lag_test_rows", with_ctes(X.REGION_BARS_SQL + ["""
lr AS (SELECT Ticker, Date, Close, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS rn FROM bars)""", """
ls AS (SELECT Ticker, Date, Close AS actual, rn - 20 AS i, count(*) OVER (PARTITION BY Ticker) AS n FROM lr WHERE rn > 20)"""], """
SELECT Ticker, Date, actual FROM ls WHERE i > floor(n * 0.8)"""))
def q_lag_test_rows(spark, sf):
    """The rows that the models on 20 lags are scored on."""
    return lag_design(spark, sf).filter("split = 'test'").select("Ticker", "Date", F.col("label").alias("actual"))


def q_forest_lags(spark, sf):
    return Mo.backtest(lag_design(spark, sf), "forest")


def q_gbt_lags(spark, sf):
    return Mo.backtest(lag_design(spark, sf), "gbt_app")


REGISTRY["forest_lags"] = (q_forest_lags, None)
REGISTRY["gbt_lags"] = (q_gbt_lags, None)


def q_model_leaderboard(spark, sf):
    """E2-E4 over the dashboard's model set: AR(5,1,0), seasonal, window
    regressor, forest and boosted trees on lags; metrics per model and key. The
    fits don't depend on each other and run side by side; each model's
    predictions are written once and read by all metrics."""
    from concurrent.futures import ThreadPoolExecutor

    from barwise.operators import metrics as Me
    from barwise.operators import timeseries as Ts
    from barwise.operators.lsq import materialize_small
    bars = materialize_small(X.region_bars(spark, sf).select("Ticker", "Date", "Close"))
    lags = lag_design(spark, sf)  # one checkpointed design for both tree models
    fits = [lambda: Mo.backtest(lags, "gbt_app"), lambda: Mo.backtest(lags, "forest"),
            lambda: Ts.ar_backtest(bars, 5, "Close", model="arima"), lambda: Ts.seasonal_backtest(bars, "Close", model="seasonal"),
            lambda: Ts.window_regressor_backtest(bars, price="Close", model="window_regressor")]
    with ThreadPoolExecutor(len(fits)) as pool:
        preds = Me.collect_backtests(*pool.map(lambda fit: materialize_small(fit()), fits))
    m = Me.regression_metrics(preds, ("model", "Ticker")).join(
        Me.direction_accuracy(preds, ("model", "Ticker")), ["model", "Ticker"])
    return Me.leaderboard(m.select("Ticker", "model", "mae", "rmse", "mape_eps_pct", "r2",
                                   "direction_pct"))


REGISTRY["model_leaderboard"] = (q_model_leaderboard, None)
