"""Evaluation (E1-E5) and backtest accumulation.

Predictions are a long table (model, Ticker, Date, actual, predicted); every
metric is one grouped aggregate over it, partial-aggregated per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions.exprs import round_cols

EPS64 = 2.220446049250313e-16  # float64 machine epsilon (fixed value)


def collect_backtests(*dfs: DataFrame) -> DataFrame:
    """One long table of all models' predictions."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def backtest_table(preds: DataFrame, error_sign: str = "pred_minus_actual") -> DataFrame:
    """E5: add the error column; sign per quirk Q9."""
    e = (F.col("predicted") - F.col("actual")) if error_sign == "pred_minus_actual" \
        else (F.col("actual") - F.col("predicted"))
    return preds.withColumn("error", e)


def regression_metrics(preds: DataFrame, by=("model",)) -> DataFrame:
    """E1 + E2: MAE, RMSE, MAPE % (sklearn and the +1e-8 variant), R^2,
    explained variance and max error per group.

    Every term is over the rows that hold both values (``n``); the others are
    counted in ``n_skipped``."""
    both = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    y, p = F.when(both, F.col("actual")), F.when(both, F.col("predicted"))
    e = p - y
    n = F.count(e)
    return preds.groupBy(*by).agg(
        n.alias("n"), (F.count(F.lit(1)) - n).alias("n_skipped"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS64))) * F.lit(100.0)).alias("mape_pct"),
        (F.avg(F.abs(F.try_divide(y - p, y + F.lit(1e-8)))) * F.lit(100.0)).alias("mape_eps_pct"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), n * F.var_pop(y))).alias("r2"),
        (F.lit(1.0) - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"))


def direction_accuracy(preds: DataFrame, by=("model", "Ticker"), date="Date") -> DataFrame:
    """% of steps where sign(change of actual) == sign(change of predicted);
    the first step has no change and is excluded; 0 for a single row."""
    w = Window.partitionBy(*by).orderBy(date)
    sa = F.signum(F.col("actual") - F.lag("actual", 1).over(w))
    sp = F.signum(F.col("predicted") - F.lag("predicted", 1).over(w))
    x = preds.select(*by, sa.alias("sa"), sp.alias("sp"))
    hit = F.when(F.col("sa").isNotNull() & F.col("sp").isNotNull(),
                 F.when(F.col("sa") == F.col("sp"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return x.groupBy(*by).agg(F.coalesce(F.avg(hit) * F.lit(100.0), F.lit(0.0)).alias("direction_pct"))


#: digits shown on the leaderboard
SHOWN_DIGITS = {"mae": 2, "rmse": 2, "mape_eps_pct": 2, "r2": 3, "direction_pct": 1}


def rounded(board: DataFrame) -> DataFrame:
    """E4 at the presentation edge: metrics rounded after ranking."""
    return round_cols(board, {c: d for c, d in SHOWN_DIGITS.items() if c in board.columns})


def accuracy(preds: DataFrame, by=("model",)) -> DataFrame:
    """Share of labels predicted right, over rows that hold both."""
    hit = (F.col("actual") == F.col("predicted")).cast("double")
    return preds.groupBy(*by).agg(F.count(hit).alias("n"), (F.avg(hit) * F.lit(100.0)).alias("accuracy_pct"))


def leaderboard(metrics: DataFrame, group=("Ticker",), model="model") -> DataFrame:
    """Rank by MAE (1 = winner) within each group and flag the best value of
    every metric (min for errors, max for R^2 and direction accuracy)."""
    g = Window.partitionBy(*group)
    r = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("mae"), F.col(model)))
    out = metrics.withColumn("rank", r.cast("int")).withColumn("is_winner", F.col("rank") == 1)
    flags = {f"best_{c}": F.col(c) == F.min(c).over(g) for c in ["mae", "rmse", "mape_eps_pct"]}
    flags.update({f"best_{c}": F.col(c) == F.max(c).over(g) for c in ["r2", "direction_pct"]})
    return out.withColumns(flags)
