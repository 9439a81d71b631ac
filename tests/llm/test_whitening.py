import numpy as np
import pytest
from conftest import SF_MID
from llm_helpers import docs_of

from barwise.llm.whitening import bidiagonalise, op13_whitening, whiten

SCHEMA = "vec_id long, embedding array<double>, component int, n int"


def brute(rows, k=8):
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    off = x * n - s
    c = off.astype(float) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, (off * off).sum(axis=1), c, e, v, np.trace(cov)


def check(got, rows, k=8, close=1e-7):
    n, dev, c, e, v, trace = brute(rows, k)
    good = int((e > 1e-12 * trace).sum())
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained - e[r.component - 1] / trace) <= 1e-9 * (e[r.component - 1] / trace)
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
    assert len(got) == good * n
    for j in range(good):
        want = c @ v[:, j] / np.sqrt(e[j])
        have = np.array([by[i, int(d)][j + 1][0] for (i, _), d in zip(rows, dev)])
        sign = np.sign(want @ have)
        assert np.abs(have * sign - want).max() <= close


def test_bidiagonalise_finds_repeated_and_small_values():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(200, 12)))[0]
    r = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    sigma = np.array([5.0, 5, 5, 3, 1, 1, 0.5, 1e-2, 1e-3, 1e-4, 0, 0])
    x = q * sigma @ r.T
    e, v = bidiagonalise(lambda z: x.T @ (x @ z), 12, float((x * x).sum()), 8)
    assert np.allclose(np.sqrt(e), sigma[:8], atol=1e-9)
    assert np.allclose(v.T @ v, np.eye(8), atol=1e-9)
    e, v = bidiagonalise(lambda z: x.T @ (x @ z), 12, float((x * x).sum()), 2)
    assert np.allclose(np.sqrt(e), 5)


def test_early_end_on_a_steep_spectrum():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(500, 60)))[0]
    x = q * 0.3 ** np.arange(60)
    passes = []
    e, _ = bidiagonalise(lambda z: passes.append(1) or x.T @ (x @ z), 60, float((x * x).sum()), 4)
    assert np.allclose(np.sqrt(e), 0.3 ** np.arange(4), rtol=1e-10) and len(passes) < 40


@pytest.mark.parametrize("d,n", [(5, 300), (12, 7), (3, 2), (1, 9), (20, 60)])
def test_against_eigenvectors(spark, d, n):
    rng = np.random.default_rng(d * n)
    x = rng.normal(size=(n, d)) * rng.uniform(0.05, 3, d)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(whiten(docs_of(spark, [(*r, 1, 2) for r in rows], SCHEMA)).collect(), rows)


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))] + [(None, [1.0, 2.0, 3.0])]
    good += [(7, [0.0, 0.0, 0.0])] * 2
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 1.0]), (54, [inf, 1.0, 1.0])]
    other = [(60, [1.0, 2.0]), (61, [2.0, -1.0]), (62, [0.5, 0.25])]
    df = docs_of(spark, [(*r, 1, 2) for r in good + bad + other], SCHEMA)
    got = whiten(df).collect()
    check([r for r in got if r.n == 43], good)
    check([r for r in got if r.n == 3], other)
    assert {r.n for r in got} == {43, 3}
    assert whiten(df.limit(0)).collect() == []
    same = docs_of(spark, [(i, [1.0, 2.0], 1, 2) for i in range(5)], SCHEMA)
    assert whiten(same).collect() == []
    huge = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1e9, 4.0])]
    assert len(whiten(docs_of(spark, [(*r, 1, 2) for r in huge], SCHEMA)).collect()) in (3, 6)


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    check(op13_whitening(spark, SF_MID).collect(), rows, close=1e-9)
