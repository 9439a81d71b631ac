"""Registered queries: splits, scaling, folds and backtest metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.functions.exprs import quantize
from barwise.operators import metrics as Me
from barwise.operators.lsq import materialize_small
from barwise.operators import rolling as Ro
from barwise.operators import splits as Sp
from barwise.plans.queries_features import PANEL_CTES, panel
from barwise.plans.registry import q_sql, register, with_ctes
from barwise.schema import SUPERVISED_FEATURES

W = "PARTITION BY Ticker ORDER BY Date"
FRAC = 0.8


@register("split_rows", with_ctes(PANEL_CTES, f"""
SELECT Ticker, Date, CASE WHEN row_number() OVER (ORDER BY Ticker, Date) - 1
  < floor(count(*) OVER () * {FRAC}) THEN 'train' ELSE 'test' END AS split FROM df_clean"""))
def q_split_rows(spark, sf):
    return Sp.split_rows(panel(spark, sf).select("Ticker", "Date"), FRAC)


@register("split_per_key", with_ctes(PANEL_CTES, f"""
SELECT Ticker, Date, CASE WHEN row_number() OVER ({W})
  <= floor(count(*) OVER (PARTITION BY Ticker) * {FRAC}) THEN 'train' ELSE 'test' END AS split FROM df_clean"""))
def q_split_per_key(spark, sf):
    return Sp.split_per_key(panel(spark, sf).select("Ticker", "Date"), FRAC)


CUT_CTES = ["""ml AS (SELECT *, lead(adj_close, 1) OVER (PARTITION BY Ticker ORDER BY Date) AS Target_Next_Price
  FROM df_clean)""", "ml1 AS (SELECT * FROM ml WHERE Target_Next_Price IS NOT NULL)",
    f"""cut AS (SELECT Date AS cutoff FROM (
  SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS di, count(*) OVER () AS nd
  FROM (SELECT DISTINCT Date FROM ml1) d) t WHERE di = floor(nd * {FRAC}))""",
    """sp AS (SELECT ml1.*, CASE WHEN Date < (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split
  FROM ml1)"""]


def ml_frame(spark, sf, cols: list[str] | None = None):
    """df_clean + next adj close target (last bar per key dropped) + P3 split;
    ``cols``: the columns a query needs (all by default)."""
    # read by the cutoff action and every model branch: checkpoint it once
    ml = Wn.targets(panel(spark, sf), "adj_close")
    ml = materialize_small(ml.select(*cols) if cols else ml)
    return Sp.split_time(ml, FRAC)


@register("split_time", with_ctes(PANEL_CTES + CUT_CTES, "SELECT Ticker, Date, split FROM sp"))
def q_split_time(spark, sf):
    return ml_frame(spark, sf, ["Ticker", "Date"]).select("Ticker", "Date", "split")


Z_COLS = ["Close", "Volume", "Daily_Return"]


@register("zscore", with_ctes(PANEL_CTES + CUT_CTES + ["zs AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in Z_COLS) + " FROM sp WHERE split = 'train')"],
    "SELECT Ticker, Date, split, " + ", ".join(
        f"{q_sql(f'({c} - m_{c}) / s_{c}')} AS z_{c}" for c in Z_COLS) + " FROM sp, zs"))
def q_zscore(spark, sf):
    z = Sp.zscore(ml_frame(spark, sf, ["Ticker", "Date", *Z_COLS]), Z_COLS, "train", suffix="_z")
    return z.select("Ticker", "Date", "split", *[quantize(f"{c}_z").alias(f"z_{c}") for c in Z_COLS])


@register("zscore_all", with_ctes(PANEL_CTES + CUT_CTES + ["za AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in Z_COLS) + " FROM sp)"],
    "SELECT Ticker, Date, split, " + ", ".join(
        f"{q_sql(f'({c} - m_{c}) / s_{c}')} AS z_{c}" for c in Z_COLS) + " FROM sp, za"))
def q_zscore_all(spark, sf):
    """Q8: scaler fitted on train + test (the reference's leakage)."""
    z = Sp.zscore(ml_frame(spark, sf, ["Ticker", "Date", *Z_COLS]), Z_COLS, None, suffix="_z")
    return z.select("Ticker", "Date", "split", *[quantize(f"{c}_z").alias(f"z_{c}") for c in Z_COLS])


@register("minmax", with_ctes(PANEL_CTES + [f"""
pk AS (SELECT Ticker, Date, adj_close, CASE WHEN row_number() OVER ({W})
  <= floor(count(*) OVER (PARTITION BY Ticker) * {FRAC}) THEN 'train' ELSE 'test' END AS split FROM df_clean)""",
    "mm AS (SELECT Ticker, min(adj_close) AS lo, max(adj_close) AS hi FROM pk WHERE split = 'train' GROUP BY Ticker)"],
    """SELECT Ticker, Date, split, adj_close, (adj_close - lo) / nullif(hi - lo, 0) AS scaled,
  (adj_close - lo) / nullif(hi - lo, 0) * (hi - lo) + lo AS restored
FROM pk JOIN mm USING (Ticker)"""))
def q_minmax(spark, sf):
    d = Sp.split_per_key(panel(spark, sf).select("Ticker", "Date", "adj_close"), FRAC)
    m = Sp.minmax(d, "adj_close", "train", name="scaled")
    m = Sp.minmax_inverse(m, "scaled", "adj_close", "restored")
    return m.select("Ticker", "Date", "split", "adj_close", "scaled", "restored")


@register("rolling_folds", with_ctes(PANEL_CTES + [f"""
tl AS (SELECT Ticker, Date, CAST(ntile(5) OVER ({W}) AS INTEGER) AS tile FROM df_clean)"""], """
SELECT Ticker, Date, tile, CAST(fold AS INTEGER) AS fold,
  CASE WHEN tile <= fold THEN 'train' ELSE 'test' END AS role
FROM tl, (SELECT unnest(range(1, 5)) AS fold) f WHERE tile <= fold + 1"""))
def q_rolling_folds(spark, sf):
    f = Sp.rolling_folds(panel(spark, sf).select("Ticker", "Date"), 4)
    return f.select("Ticker", "Date", F.col("tile").cast("int").alias("tile"),
                    F.col("fold").cast("int").alias("fold"), "role")


# ------------------------------------------------------------ baseline backtests
PRED_CTES = PANEL_CTES + CUT_CTES + [
    """ar AS (SELECT Ticker, regr_slope(Target_Next_Price, adj_close) AS b,
       regr_intercept(Target_Next_Price, adj_close) AS a FROM sp WHERE split = 'train' GROUP BY Ticker)""",
    """preds AS (
  SELECT 'last_value' AS model, Ticker, Date, Target_Next_Price AS actual, adj_close AS predicted
  FROM sp WHERE split = 'test'
  UNION ALL SELECT 'ma7', Ticker, Date, Target_Next_Price, MA7 FROM sp WHERE split = 'test'
  UNION ALL SELECT 'ar1', sp.Ticker, Date, Target_Next_Price, a + b * adj_close
  FROM sp JOIN ar ON sp.Ticker = ar.Ticker WHERE split = 'test')"""]


def baseline_predictions(spark, sf):
    """U1 over three SQL-computable forecasters of the next adj close."""
    ml = ml_frame(spark, sf, ["Ticker", "Date", "adj_close", "MA7", "Target_Next_Price"])
    test = ml.filter(F.col("split") == "test")
    base = ["Ticker", "Date", F.col("Target_Next_Price").alias("actual")]
    lv = test.select(F.lit("last_value").alias("model"), *base, F.col("adj_close").alias("predicted"))
    ma = test.select(F.lit("ma7").alias("model"), *base, F.col("MA7").alias("predicted"))
    coef = ml.filter(F.col("split") == "train").groupBy("Ticker").agg(
        F.regr_slope("Target_Next_Price", "adj_close").alias("b"),
        F.regr_intercept("Target_Next_Price", "adj_close").alias("a"))
    ar = test.join(coef, "Ticker").select(F.lit("ar1").alias("model"), *base,
                                          (F.col("a") + F.col("b") * F.col("adj_close")).alias("predicted"))
    return Me.collect_backtests(lv, ma, ar)


METRIC_COLS = ["mae", "rmse", "mape_pct", "mape_eps_pct", "r2", "explained_variance", "max_error",
               "direction_pct"]
METRIC_CTES = PRED_CTES + [
    """reg AS (SELECT model, Ticker, count(*) AS n, count(*) - count(predicted - actual) AS n_skipped,
  avg(abs(predicted - actual)) AS mae,
  sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
  avg(abs(predicted - actual) / greatest(abs(actual), 2.220446049250313e-16)) * 100 AS mape_pct,
  avg(abs((actual - predicted) / nullif(actual + 1e-8, 0))) * 100 AS mape_eps_pct,
  1 - sum((predicted - actual) * (predicted - actual)) / nullif(count(*) * var_pop(actual), 0) AS r2,
  1 - var_pop(predicted - actual) / nullif(var_pop(actual), 0) AS explained_variance,
  max(abs(predicted - actual)) AS max_error
  FROM preds GROUP BY model, Ticker)""",
    """dd AS (SELECT model, Ticker,
  sign(actual - lag(actual, 1) OVER (PARTITION BY model, Ticker ORDER BY Date)) AS sa,
  sign(predicted - lag(predicted, 1) OVER (PARTITION BY model, Ticker ORDER BY Date)) AS sp_
  FROM preds)""",
    """dir AS (SELECT model, Ticker, coalesce(avg(CASE WHEN sa IS NOT NULL AND sp_ IS NOT NULL THEN
  CASE WHEN sa = sp_ THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) * 100, CAST(0 AS DOUBLE)) AS direction_pct
  FROM dd GROUP BY model, Ticker)""",
    "met AS (SELECT * FROM reg JOIN dir USING (model, Ticker))"]


def baseline_metrics(spark, sf):
    p = baseline_predictions(spark, sf)
    m = Me.regression_metrics(p, ("model", "Ticker")).join(
        Me.direction_accuracy(p, ("model", "Ticker")), ["model", "Ticker"])
    return m.withColumns({c: quantize(c) for c in METRIC_COLS})


@register("baseline_metrics", with_ctes(METRIC_CTES, "SELECT model, Ticker, n, n_skipped, " + ", ".join(
    f"{q_sql(c)} AS {c}" for c in METRIC_COLS) + " FROM met"))
def q_baseline_metrics(spark, sf):
    return baseline_metrics(spark, sf)


@register("leaderboard", with_ctes(METRIC_CTES + ["qm AS (SELECT model, Ticker, " + ", ".join(
    f"{q_sql(c)} AS {c}" for c in ["mae", "rmse", "mape_eps_pct", "r2", "direction_pct"]) + " FROM met)"], """
SELECT Ticker, model, mae, rmse, mape_eps_pct, r2, direction_pct,
  CAST(row_number() OVER (PARTITION BY Ticker ORDER BY mae, model) AS INTEGER) AS rank,
  row_number() OVER (PARTITION BY Ticker ORDER BY mae, model) = 1 AS is_winner,
  mae = min(mae) OVER (PARTITION BY Ticker) AS best_mae,
  rmse = min(rmse) OVER (PARTITION BY Ticker) AS best_rmse,
  mape_eps_pct = min(mape_eps_pct) OVER (PARTITION BY Ticker) AS best_mape_eps_pct,
  r2 = max(r2) OVER (PARTITION BY Ticker) AS best_r2,
  direction_pct = max(direction_pct) OVER (PARTITION BY Ticker) AS best_direction_pct
FROM qm"""))
def q_leaderboard(spark, sf):
    m = baseline_metrics(spark, sf).select("Ticker", "model", "mae", "rmse", "mape_eps_pct", "r2",
                                           "direction_pct")
    return Me.leaderboard(m)


@register("leaderboard_rounded", with_ctes(METRIC_CTES + ["qm AS (SELECT model, Ticker, " + ", ".join(
    f"{q_sql(c)} AS {c}" for c in Me.SHOWN_DIGITS) + " FROM met)"], "SELECT Ticker, model, " + ", ".join(
    f"round({c}, {d}) AS {c}" for c, d in Me.SHOWN_DIGITS.items()) + """,
  CAST(row_number() OVER (PARTITION BY Ticker ORDER BY mae, model) AS INTEGER) AS rank FROM qm"""))
def q_leaderboard_rounded(spark, sf):
    m = baseline_metrics(spark, sf).select("Ticker", "model", *Me.SHOWN_DIGITS)
    return Me.rounded(Me.leaderboard(m)).select("Ticker", "model", *Me.SHOWN_DIGITS, "rank")


FOLD_METRICS = ["mae", "rmse", "mape_eps_pct", "r2"]


ROLLING_SQL = with_ctes(PANEL_CTES + CUT_CTES[:2] + [f"""
ft AS (SELECT Ticker, Date, adj_close, Target_Next_Price, ntile(5) OVER ({W}) AS tile FROM ml1)""", """
ff AS (SELECT ft.*, CAST(fold AS INTEGER) AS fold, tile <= fold AS train
  FROM ft, (SELECT unnest(range(1, 5)) AS fold) f WHERE tile <= fold + 1)""", """
fc AS (SELECT Ticker, fold, regr_slope(Target_Next_Price, adj_close) AS b, regr_intercept(Target_Next_Price, adj_close) AS a
  FROM ff WHERE train GROUP BY Ticker, fold)""", """
fp AS (SELECT ff.Ticker, ff.fold, Target_Next_Price AS actual, a + b * adj_close AS predicted
  FROM ff JOIN fc ON ff.Ticker = fc.Ticker AND ff.fold = fc.fold WHERE NOT train)""", """
fm AS (SELECT Ticker, fold, count(*) AS n, avg(abs(predicted - actual)) AS mae,
  sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse,
  avg(abs((actual - predicted) / nullif(actual + 1e-8, 0))) * 100 AS mape_eps_pct,
  1 - sum((predicted - actual) * (predicted - actual)) / nullif(count(*) * var_pop(actual), 0) AS r2
  FROM fp GROUP BY Ticker, fold)"""], "SELECT Ticker, fold, n, " + ", ".join(
    f"{q_sql(c, 16)} AS {c}" for c in FOLD_METRICS) + " FROM fm")


@register("rolling_scores", ROLLING_SQL)
def q_rolling_scores(spark, sf):
    """AR(1) fitted anew on every expanding fold and scored on the tile after it."""
    ml = Wn.targets(panel(spark, sf), "adj_close").select("Ticker", "Date", "adj_close", "Target_Next_Price")
    folds = Sp.rolling_folds(materialize_small(ml), 4)
    coef = folds.filter("role = 'train'").groupBy("Ticker", "fold").agg(
        F.regr_slope("Target_Next_Price", "adj_close").alias("b"),
        F.regr_intercept("Target_Next_Price", "adj_close").alias("a"))
    preds = folds.filter("role = 'test'").join(coef, ["Ticker", "fold"]).select(
        "Ticker", "fold", F.col("Target_Next_Price").alias("actual"), (F.col("a") + F.col("b") * F.col("adj_close")).alias("predicted"))
    m = Me.regression_metrics(preds, ("Ticker", "fold"))
    return m.select("Ticker", F.col("fold").cast("int").alias("fold"), "n", *[quantize(c, 16).alias(c) for c in FOLD_METRICS])


def _fold_scores(preds):
    m = Me.regression_metrics(preds, ("Ticker", "fold"))
    return m.select("Ticker", F.col("fold").cast("int").alias("fold"), "n", *[quantize(c, 16).alias(c) for c in FOLD_METRICS])


@register("rolling_refits", ROLLING_SQL)
def q_rolling_refits(spark, sf):
    """``rolling_scores`` from prefix-summed Gram matrices."""
    ml = Wn.targets(panel(spark, sf), "adj_close").select("Ticker", "Date", "adj_close", "Target_Next_Price")
    return _fold_scores(Ro.rolling_refits(ml, ["adj_close"], "Target_Next_Price", 4))


def _rolling_all(spark, sf, ridge):
    ml = Wn.targets(panel(spark, sf), "adj_close").select("Ticker", "Date", *SUPERVISED_FEATURES, "Target_Next_Price")
    return _fold_scores(Ro.rolling_refits(ml, SUPERVISED_FEATURES, "Target_Next_Price", 4, ridge))


@register("rolling_linear")
def q_rolling_linear(spark, sf):
    """All features, least squares fitted anew on every expanding fold."""
    return _rolling_all(spark, sf, 0.0)


@register("rolling_ridge")
def q_rolling_ridge(spark, sf):
    """All features, ridge with alpha 1 on every expanding fold."""
    return _rolling_all(spark, sf, 1.0)


@register("backtest_table", with_ctes(PRED_CTES, f"""
SELECT model, Ticker, Date, actual, {q_sql('predicted')} AS predicted,
  {q_sql('predicted - actual')} AS error FROM preds"""))
def q_backtest_table(spark, sf):
    b = Me.backtest_table(baseline_predictions(spark, sf))
    return b.withColumns({"predicted": quantize("predicted"), "error": quantize("error")})
