"""Supervised models (M1-M6, M16): MLlib for linear, ridge and the dense net, the
lasso on a Gram matrix, ``trees`` and ``boosting`` for the rest.

Every estimator runs as Spark jobs (aggregated gradients / Gram matrices /
histograms); only fitted parameters reach the driver. Inputs are the
engineered panel with a next-price target, a calendar split (P3), and
z-scores fitted on the train part (P4). Outputs are long backtest rows
(model, Ticker, Date, actual, predicted) for the test part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.operators.boosting import PRESETS, boost
from barwise.operators.lsq import grouped_gram, materialize_small, spread
from barwise.operators.splits import time_cutoff, zscore
from barwise.operators.trees import forest_predict
from barwise.schema import SUPERVISED_FEATURES


def design(ml: DataFrame, features=tuple(SUPERVISED_FEATURES), label="Target_Next_Price",
           split="split", fit_on: str | None = "train") -> DataFrame:
    """z-score the features on ``fit_on`` rows, assemble ``features`` vector and
    checkpoint (several models read the same design)."""
    cols = list(features)
    z = zscore(ml, cols, fit_on, split)
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    out = va.transform(z).select("Ticker", "Date", split, F.col(label).alias("label"), "features")
    return materialize_small(spread(out))


def _backtest(model, test: DataFrame, name: str) -> DataFrame:
    return _named(model.transform(test), name)


def _named(predicted: DataFrame, name: str) -> DataFrame:
    return predicted.select(F.lit(name).alias("model"), "Ticker", "Date",
                                        F.col("label").alias("actual"),
                                        F.col("prediction").alias("predicted"))


def _train_test(d: DataFrame, split="split"):
    return d.filter(F.col(split) == "train"), d.filter(F.col(split) == "test")


def fit_linear(train: DataFrame):
    """M1: ordinary least squares (normal equations)."""
    return LinearRegression(regParam=0.0, solver="normal", standardization=False).fit(train)


def fit_ridge(train: DataFrame, alpha: float = 1.0):
    """M2: ridge with sklearn's alpha. MLlib scales the L2 term by the label's
    std and the row count, so regParam = alpha * std_pop(label) / n."""
    st = train.agg(F.stddev_pop("label").alias("s"), F.count(F.lit(1)).alias("n")).first()
    reg = alpha * float(st["s"] or 0.0) / max(int(st["n"]), 1)
    return LinearRegression(regParam=reg, elasticNetParam=0.0, solver="normal",
                            standardization=False).fit(train)


def lasso_descent(gram: np.ndarray, cov: np.ndarray, alpha: float, sweeps: int = 20_000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent on mean products: min 1/2 b'Gb - c'b + alpha |b|_1,
    swept until no coefficient's effect moves by more than ``tol`` of the largest."""
    d = np.diag(gram)
    beta, grad = np.zeros(len(cov)), cov.copy()  # grad = cov - gram @ beta
    live = np.flatnonzero(d > 0)
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            old, z = beta[j], grad[j] + d[j] * beta[j]
            new = math.copysign(max(abs(z) - alpha, 0.0), z) / d[j]
            if new != old:
                grad -= gram[:, j] * (new - old)
                beta[j] = new
                moved = max(moved, abs(new - old) * math.sqrt(d[j]))
        if moved <= tol * max(1e-300, float(np.max(np.abs(beta) * np.sqrt(d), initial=0.0))):
            break
    return beta


@dataclass
class LinearFit:
    """A constant and one coefficient a feature."""
    const: float
    beta: list[float]

    def transform(self, df: DataFrame, features="features", name="prediction") -> DataFrame:
        terms = F.zip_with(vector_to_array(features), F.array(*[F.lit(b) for b in self.beta]), lambda a, b: a * b)
        return df.withColumn(name, F.lit(self.const) + F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))


def fit_lasso(train: DataFrame, alpha: float = 0.001, sweeps: int = 20_000, label="label", features="features") -> LinearFit:
    """M3: lasso by coordinate descent on the Gram matrix: one pass over the rows
    (after one for the means), then sweeps over k x k numbers. A constant feature
    has coefficient 0."""
    first = train.select(F.size(vector_to_array(features)).alias("k")).first()
    if first is None:
        return LinearFit(0.0, [])
    k, x = first.k, vector_to_array(features)
    cols = [f"x{j}" for j in range(k)]
    mean = train.agg(*[F.avg(x[j]).alias(c) for j, c in enumerate(cols)], F.avg(label).alias("y")).first()
    rows = train.select(F.lit("all").alias("key"), *[(x[j] - F.lit(mean[c])).alias(c) for j, c in enumerate(cols)],
                        (F.col(label) - F.lit(mean["y"])).alias("y"))
    g = grouped_gram(rows, "key", cols, "y").first()
    beta = lasso_descent(np.reshape(g.xtx, (k, k)) / g.n, np.array(g.xty) / g.n, alpha, sweeps)
    return LinearFit(float(mean["y"] - sum(b * mean[c] for b, c in zip(beta, cols))), beta.tolist())


def fit_gbt(train: DataFrame, preset: str = "leafwise", max_rounds: int = 2000, patience: int = 100, seed: int = 42,
            valid_frac: float = 0.1):
    """M5/M6: boosted trees with early stopping on an own validation slice (the
    last 10 % of train dates, quirk Q10): the run ends when the validation error
    has not improved for ``patience`` rounds, or after ``max_rounds``. The model
    has the trees up to the best round."""
    cut = time_cutoff(train, 1.0 - valid_frac)
    if not cut:
        return boost(train, None, PRESETS[preset], max_rounds, None, seed)
    early = F.col("Date") < F.lit(cut)
    return boost(train.filter(early), train.filter(~early), PRESETS[preset], max_rounds, patience, seed)


def fit_direction(train: DataFrame, n_features: int, seed: int = 42, max_iter: int = 100):
    """up/down classifier, dense net with 100-50-25 hidden units."""
    mlp = MultilayerPerceptronClassifier(layers=[n_features, 100, 50, 25, 2], seed=seed,
                                         maxIter=max_iter, labelCol="label")
    return mlp.fit(train)


def backtest(d: DataFrame, model_name: str, **kw) -> DataFrame:
    """Fit one named model on the train part and predict the test part."""
    train, test = _train_test(d)
    if model_name == "linear":
        m = fit_linear(train)
    elif model_name == "ridge":
        m = fit_ridge(train, **kw)
    elif model_name == "lasso":
        m = fit_lasso(train, **kw)
    elif model_name == "forest":
        return _named(forest_predict(train, test, **kw), model_name)
    elif model_name == "gbt_app":
        m = boost(train, None, PRESETS["app"], kw.get("rounds", 500))
    elif model_name.startswith("gbt_"):
        m = fit_gbt(train, preset=model_name[4:], **kw)
    else:
        raise ValueError(model_name)
    return _backtest(m, test, model_name)


def direction_backtest(ml: DataFrame, **kw) -> DataFrame:
    """Label = Target_Direction (next adj close above the current one)."""
    d = design(ml, label="Target_Direction")
    d = d.withColumn("label", F.col("label").cast("double"))
    train, test = _train_test(d)
    m = fit_direction(train, len(SUPERVISED_FEATURES), **kw)
    return _backtest(m, test, "direction")
