"""Extreme pairs without the pair table, Euclidean silhouette: against numpy."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector

from barwise.operators.correlation import extreme_correlations
from barwise.operators.unsupervised import silhouette


@pytest.mark.parametrize("block,self_pairs", [(1024, False), (3, False), (4, True)])
def test_extreme_pairs(spark, block, self_pairs):
    rng, rows = np.random.default_rng(3), []
    base = rng.normal(size=200)
    for k in range(11):
        v = rng.normal(size=200) + (k % 3 - 1) * base
        rows += [(f"k{k:02d}", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(v[i])) for i in range(200) if rng.random() < 0.8]
    rows += [("flat", dt.date(2000, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(50)]
    rows += [("once", dt.date(2000, 1, 3), 4.0), ("null", dt.date(2000, 1, 3), None)]
    df = spark.createDataFrame(rows, "Ticker string, Date date, r double")
    c = pd.DataFrame(rows, columns=["k", "d", "r"]).pivot(index="d", columns="k", values="r").corr(min_periods=2)
    names = sorted(c.columns)
    pairs = [(c.loc[a, b], a, b) for i, a in enumerate(names) for b in names[i + (not self_pairs):] if not np.isnan(c.loc[a, b])]
    got = {r.kind: r for r in extreme_correlations(df, "r", block_keys=block, exclude_self=not self_pairs, grid=2.0 ** -20).collect()}
    assert (got["weakest"].ticker_a, got["weakest"].ticker_b) == min(pairs)[1:]
    if self_pairs:
        assert got["strongest"].ticker_a == got["strongest"].ticker_b == names[1] and got["strongest"].corr == 1.0
    else:
        assert (got["strongest"].ticker_a, got["strongest"].ticker_b) == max(pairs)[1:]
    assert abs(got["weakest"].corr - min(pairs)[0]) < 1e-6
    assert extreme_correlations(df.limit(0), "r").count() == 0


@pytest.mark.parametrize("shard_rows", [65_536, 100])
def test_silhouette_is_euclidean(spark, shard_rows):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(1200, 3)), rng.normal(size=(799, 3)) + 2, [[9.0, 9.0, 9.0]]])
    label = np.array([0] * 1200 + [1] * 799 + [5])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    sums = np.stack([d[:, label == c].sum(axis=1) for c in (0, 1, 5)], axis=1)
    n = np.array([1200, 799, 1])
    at = np.array([(0, 1, 5).index(c) for c in label])
    a = sums[np.arange(2000), at] / np.maximum(n[at] - 1, 1)
    other = np.where(np.arange(3) == at[:, None], np.inf, sums / n).min(axis=1)
    want = np.where(n[at] > 1, (other - a) / np.maximum(a, other), 0.0).mean()
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(label, x)], "c int, v array<double>").repartition(5)
    df = df.select("c", array_to_vector("v").alias("features"))
    assert abs(silhouette(df, "c", shard_rows=shard_rows) - want) < 1e-9
    assert silhouette(df.filter("c = 1"), "c") is None
    assert abs(silhouette(df, "c", "squared") - want) > 0.01
