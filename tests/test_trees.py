"""Trees, forest and boosting against plain numpy growth."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from barwise.operators.boosting import BINS, PRESETS, Booster, Preset, boost, grow
from barwise.operators.trees import Tree, best_split, binned, forest_predict, grow_exact, histogram, weights


def plain_tree(x, y, w):
    def rec(i):
        if np.ptp(y[i]) == 0:
            return float(y[i][0])
        best = None
        for f in range(x.shape[1]):
            o = i[np.argsort(x[i, f], kind="stable")]
            for k in range(len(o) - 1):
                if x[o[k], f] < x[o[k + 1], f]:
                    a, b = o[:k + 1], o[k + 1:]
                    s = (w[a] @ y[a]) ** 2 / w[a].sum() + (w[b] @ y[b]) ** 2 / w[b].sum()
                    if best is None or s > best[0] + 1e-9:
                        best = s, f, (x[o[k], f] + x[o[k + 1], f]) / 2
        if best is None:
            return float(np.average(y[i], weights=w[i]))
        _, f, c = best
        return f, c, rec(i[x[i, f] <= c]), rec(i[x[i, f] > c])

    return rec(np.flatnonzero(w > 0))


def answer(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def frame(spark, x, y, first=0):
    rows = [("k", dt.date(2000, 1, 1) + dt.timedelta(days=first + i), v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "Ticker string, Date date, a array<double>, label double")
    return df.select("Ticker", "Date", "label", array_to_vector("a").alias("features"))


@pytest.mark.parametrize("seed,digits", [(0, 1), (1, 3), (2, 0)])
def test_exact_tree_equals_plain_growth(seed, digits):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(size=(90, 3)).round(digits), rng.integers(0, 3, 90).astype(float)
    y = np.round(rng.normal(size=90), 2)
    tree, plain, z = grow_exact(x, y, w), plain_tree(x, y, w), rng.normal(size=(200, 3))
    assert np.allclose(tree.predict(z), [answer(plain, r) for r in z], atol=1e-12)
    assert grow_exact(x[:0], y[:0], w[:0]).predict(z[:2]).shape == (2,)
    assert np.allclose(grow_exact(np.ones((4, 2)), y[:4], np.ones(4)).predict(z[:1]), y[:4].mean())


def test_one_tree_without_bootstrap(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(150, 3)), rng.normal(size=(40, 3))
    y = x[:, 0] + rng.normal(size=150)
    plain = plain_tree(x, y, np.ones(150))
    got = forest_predict(frame(spark, x, y), frame(spark, z, np.zeros(40), 500), trees=1, bootstrap=False).orderBy("Date").collect()
    assert np.allclose([r.prediction for r in got], [answer(plain, r) for r in z])


def test_forest_is_the_mean_of_its_trees(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=(120, 3)), rng.normal(size=(30, 3))
    y = x[:, 0] * 2 + rng.normal(size=120)
    train, rows = frame(spark, x, y), frame(spark, z, np.zeros(30), 500)
    from pyspark.sql import functions as F
    h = np.array([[r.h, 0] for r in train.select(F.xxhash64("Ticker", "Date").alias("h")).collect()], np.int64)
    want = np.mean([grow_exact(x, y, weights(h, t, 42, True)).predict(z) for t in range(20)], axis=0)
    got = forest_predict(train, rows, trees=20).orderBy("Date").collect()
    assert np.allclose([r.prediction for r in got], want)
    assert forest_predict(train.limit(0), rows, trees=3).filter("prediction IS NULL").count() == 30
    assert forest_predict(train, rows.limit(0), trees=3).count() == 0


def test_split_tops_grow_on_in_groups(spark):
    """Nodes over 25 rows are split by Spark over bins, the rest in groups; with
    distinct values on few points the bins hold every threshold."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (200, 3)).astype(float)
    y = x[:, 1] * 3 + rng.normal(size=200)
    train = frame(spark, x, y)
    got = forest_predict(train, train, trees=4, bootstrap=False, task_rows=25).orderBy("Date").collect()
    uniq, at = np.unique(x, axis=0, return_inverse=True)
    mean = np.array([y[at == i].mean() for i in range(len(uniq))])[at]
    assert np.allclose([r.prediction for r in got], mean)  # pure or equal in x: train rows come back


def best_first(bins, res, preset, width):
    """One leaf at a time, histograms counted anew."""
    tree, level = Tree(), {0: 0}
    tree.add()
    while sum(f < 0 for f in tree.feature) < (preset.leaves or 10 ** 9):
        leaf = tree.leaves(bins)
        gains = []
        for n, f in enumerate(tree.feature):
            if f < 0 and (preset.depth is None or level[n] < preset.depth):
                h = histogram(bins, np.where(leaf == n, 0, -1), 1, width, np.ones(len(res)), res)[0]
                gains.append((*best_split(h, preset.least, preset.penalty), n))
        gains = [g for g in gains if g[0] > 1e-12]
        if not gains:
            break
        gain, f, cell, n = max(gains, key=lambda g: (g[0], -g[3]))
        for c in tree.split(n, f, float(cell)):
            level[c] = level[n] + 1
    leaf = tree.leaves(bins)
    for n in np.unique(leaf):
        tree.value[n] = preset.rate * res[leaf == n].sum() / ((leaf == n).sum() + preset.penalty)
    return tree


@pytest.mark.parametrize("preset", [Preset(leaves=9, least=5.0), Preset(depth=4, penalty=1.0), Preset(leaves=31, least=20.0)])
def test_batched_growth_equals_one_leaf_at_a_time(preset):
    rng = np.random.default_rng(8)
    bins, res = rng.integers(0, 20, (600, 5)), rng.normal(size=600)
    res += (bins[:, 0] > 7) * 2.0 + (bins[:, 1] > 3) * (bins[:, 2] < 9)
    asked = []

    def ask(tree, nodes):
        asked.append(nodes)
        table = np.full(len(tree.feature), -1)
        table[nodes] = range(len(nodes))
        return histogram(bins, table[tree.leaves(bins)], len(nodes), 20, np.ones(600), res)

    got, want = grow(ask, preset, None), best_first(bins, res, preset, 20)
    assert np.allclose(got.predict(bins), want.predict(bins))
    assert sum(f < 0 for f in got.feature) == sum(f < 0 for f in want.feature)
    assert len(asked) < sum(f >= 0 for f in got.feature)  # fewer questions than splits


@pytest.mark.parametrize("name", ["leafwise", "depthwise"])
def test_patience_ends_the_run_and_blocks_do_not_matter(spark, name):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4))
    y = np.sin(x[:, 0] * 2) + 0.5 * rng.normal(size=500)
    train, valid = frame(spark, x[:400], y[:400]), frame(spark, x[400:], y[400:], 400)
    one = boost(train, valid, replace(PRESETS[name], rate=0.3), 400, patience=8)
    assert len(one.errors) == len(one.trees) + 8 and one.errors[len(one.trees) - 1] == min(one.errors)
    assert math.isclose(np.abs(one.predict(x[400:]) - y[400:]).mean(), min(one.errors))
    many = boost(train, valid, replace(PRESETS[name], rate=0.3), 4, patience=8, block_rows=150)
    assert np.allclose(many.errors, one.errors[:4])
    got = one.transform(valid).orderBy("Date").collect()
    assert np.allclose([r.prediction for r in got], one.predict(x[400:]))


def test_fixed_rounds_and_empty(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 3))
    y = x[:, 0] + 0.1 * rng.normal(size=200)
    train = frame(spark, x, y)
    m = boost(train, None, PRESETS["app"], 60)
    assert len(m.trees) == 60 and m.errors == []
    assert np.abs(m.predict(x) - y).mean() < 0.2 * np.abs(y - y.mean()).mean()
    assert boost(train.limit(0), None, PRESETS["app"], 5).trees == []
    assert isinstance(m, Booster) and BINS <= 255
    assert binned(np.array([[1.0], [2.0], [2.5]]), [np.array([1.0, 2.0])]).ravel().tolist() == [0, 1, 2]


def test_lasso_equals_descent_and_closed_form(spark):
    from barwise.operators.models import fit_lasso, lasso_descent
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 6))
    x[:, 4] = x[:, 0] + 0.1 * x[:, 1]
    x[:, 5] = 3.0  # no effect of its own
    y = x[:, 0] * 2 - x[:, 2] + 0.3 * rng.normal(size=300) + 5
    m = fit_lasso(frame(spark, x, y), alpha=0.05)
    xc, yc, beta = x - x.mean(axis=0), y - y.mean(), np.zeros(6)
    for _ in range(8_000):  # on the rows, one coefficient at a time
        for j in range(5):
            r = yc - xc @ beta + xc[:, j] * beta[j]
            z = xc[:, j] @ r / 300
            beta[j] = np.sign(z) * max(abs(z) - 0.05, 0) / (xc[:, j] @ xc[:, j] / 300)
    assert np.allclose(m.beta, beta, atol=1e-8) and m.beta[5] == 0
    assert math.isclose(m.const, y.mean() - x.mean(axis=0) @ beta, abs_tol=1e-8)
    q = np.linalg.qr(rng.normal(size=(50, 4)))[0]
    c = q.T @ rng.normal(size=50)
    assert np.allclose(lasso_descent(q.T @ q, c, 0.2), np.sign(c) * np.maximum(np.abs(c) - 0.2, 0))
