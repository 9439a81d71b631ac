"""Rolling-origin refits from prefix sums of Gram matrices (P6 x M1, M2, M12).

A key's rows are cut into k + 1 date-ordered tiles; fold i is fitted on tiles
<= i and scored on tile i + 1. One pass gives one Gram matrix a (key, tile);
summed up along the tiles they are the matrices of all folds, so k expanding
folds cost the work of one fit and no row is copied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwise.operators.lsq import grouped_gram, materialize_small, solve_scaled


def fold_models(rows: DataFrame, features: list[str], label: str, k: int, ridge: float = 0.0, key="Ticker",
                tile="tile") -> DataFrame:
    """(key as text, fold, n, beta): least squares with a constant of each fold.
    ``ridge`` is the penalty on standardised features (as M2 fits them), the
    constant and the scale being those of the fold's own train rows."""
    gram = grouped_gram(rows.withColumn("_one", F.lit(1.0)), key, ["_one", *features], label, tile)
    d = len(features) + 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out, pdf = [], pdf.sort_values("part")
        n, xtx, xty, yty = 0, np.zeros((d, d)), np.zeros(d), 0.0
        sums = {int(r.part): r for r in pdf.itertuples()}
        for fold in range(1, k + 1):
            if (r := sums.get(fold)) is not None:
                n, xtx, xty, yty = n + int(r.n), xtx + np.asarray(r.xtx).reshape(d, d), xty + np.asarray(r.xty), yty + r.yty
            if n:
                out.append((pdf["key"].iloc[0], fold, n, centred_fit(n, xtx, xty, yty, ridge).tolist()))
        return pd.DataFrame(out, columns=["_k", "fold", "n_train", "beta"])

    return materialize_small(gram.groupBy("key").applyInPandas(fit, "_k string, fold int, n_train long, beta array<double>"))


def centred_fit(n: int, xtx: np.ndarray, xty: np.ndarray, yty: float, ridge: float) -> np.ndarray:
    """Constant and coefficients from raw Gram sums whose first column is one."""
    mean, ymean = xtx[0, 1:] / n, xty[0] / n
    a = xtx[1:, 1:] - n * np.outer(mean, mean)
    b = xty[1:] - n * mean * ymean
    std = np.sqrt(np.maximum(np.diag(a), 0.0) / n)
    flat = std <= 1e-12 * np.sqrt(np.maximum(np.diag(xtx)[1:] / n, 1e-300))
    std = np.where(flat, 1.0, std)
    a, b = np.where(flat[:, None] | flat[None, :], 0.0, a / np.outer(std, std)), np.where(flat, 0.0, b / std)
    beta = solve_scaled(a, b, yty, ridge)[0] / std
    return np.concatenate([[ymean - beta @ mean], beta])


def rolling_refits(df: DataFrame, features: list[str], label: str, k: int = 4, ridge: float = 0.0, key="Ticker",
                   date="Date") -> DataFrame:
    """(key, date, fold, actual, predicted) for every row of the tiles after the
    first, predicted by the model of the tiles before its own. Rows with a null
    feature or label are neither fitted nor scored."""
    rows = df.select(key, date, *dict.fromkeys([*features, label])).na.drop(subset=[*dict.fromkeys([*features, label])])
    tile = F.ntile(k + 1).over(Window.partitionBy(key).orderBy(date))
    rows = materialize_small(rows.withColumn("tile", tile))
    models = fold_models(rows, features, label, k, ridge, key)
    same = (F.col(key).cast("string") == F.col("_k")) & (F.col("tile") == F.col("fold") + 1)
    terms = F.zip_with(F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]), "beta", lambda x, b: x * b)
    yhat = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    return rows.join(models, same).select(key, date, "fold", F.col(label).alias("actual"), yhat.alias("predicted"))
