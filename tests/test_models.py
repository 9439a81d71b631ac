"""Model checks against independent numpy computations (test side only)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwise.operators import models as Mo
from barwise.operators import timeseries as Ts
from barwise.operators import unsupervised as U
from barwise.operators.lsq import grouped_gram, solve
from barwise.plans.queries_eval import ml_frame
from barwise.plans.queries_features import panel
from barwise.schema import SUPERVISED_FEATURES
from barwise.sources import fixtures as X
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def design(spark):
    return Mo.design(ml_frame(spark, SF_SMALL)).cache()


def _xy(d):
    rows = d.filter("split = 'train'").select("features", "label").collect()
    X_ = np.array([r.features.toArray() for r in rows])
    return X_, np.array([r.label for r in rows])


def test_ridge_matches_closed_form(spark, design):
    X_, y = _xy(design)
    alpha = 1.0
    m = Mo.fit_ridge(design.filter("split = 'train'"), alpha)
    Xc, yc = X_ - X_.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X_.shape[1]), Xc.T @ yc)
    pred = m.transform(design.filter("split = 'train'")).select("prediction").toPandas()["prediction"]
    ref = X_ @ beta + (y.mean() - X_.mean(0) @ beta)
    assert np.allclose(pred.to_numpy(), ref, rtol=1e-6, atol=1e-6)


def test_grouped_gram_matches_lstsq(spark):
    walk = X.walk_bars(spark, SF_SMALL)
    coef = {r.Ticker: (r.const, list(r.phi)) for r in Ts.fit_ar(walk, 2, "Close").collect()}
    pdf = walk.toPandas().sort_values(["Ticker", "Date"])
    for t, g in pdf.groupby("Ticker"):
        dy = g["Close"].diff().to_numpy()
        Y = dy[3:]
        A = np.column_stack([np.ones(len(Y)), dy[2:-1], dy[1:-2]])
        ref = np.linalg.lstsq(A, Y, rcond=None)[0]
        got = np.array([coef[t][0]] + coef[t][1])
        assert np.allclose(got, ref, atol=1e-8)


def test_df_test_rejects_on_bars_not_on_walk(spark):
    b = {r.Ticker: r.stationary for r in Ts.df_test(X.region_bars(spark, SF_SMALL)).collect()}
    w = {r.Ticker: r.stationary for r in Ts.df_test(X.walk_bars(spark, SF_SMALL)).collect()}
    assert all(b.values()) and not any(w.values())


def test_mackinnon_p_monotone():
    ps = [Ts.mackinnon_p(t) for t in [-6.0, -3.5, -2.86, -1.0, 0.5]]
    assert ps == sorted(ps) and ps[0] < 0.01 and 0.04 < Ts.mackinnon_p(-2.86) < 0.06


def test_pca_ratios_sum_to_one(spark):
    d = U.unsup_design(panel(spark, SF_SMALL))
    comp, load = U.pca_summary(d)
    r = comp.agg(F.sum("ratio")).first()[0]
    assert math.isclose(r, 1.0, abs_tol=1e-9)
    assert load.count() == 24


def test_isolation_flags_contamination_share(spark):
    d = U.unsup_design(panel(spark, SF_SMALL))
    s = U.isolation_scores(d, trees=50)
    share = s.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert 0.005 < share < 0.04
    sc = s.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 < sc[0] <= sc[1] < 1


def test_gmm_probabilities_sum_to_one(spark):
    d = U.unsup_design(panel(spark, SF_SMALL))
    out, ll, sil = U.fit_states(d)
    tot = out.select(sum(F.col(f"State_{i}") for i in range(4)).alias("t")).agg(
        F.min("t"), F.max("t")).first()
    assert abs(tot[0] - 1) < 1e-9 and abs(tot[1] - 1) < 1e-9 and math.isfinite(ll)


def test_solve_recovers_coefficients():
    rng = np.random.default_rng(0)
    A = rng.normal(size=(200, 3))
    y = A @ np.array([1.0, -2.0, 0.5])
    beta, ssr, _ = solve((A.T @ A).ravel(), A.T @ y, float(y @ y), 200)
    assert np.allclose(beta, [1.0, -2.0, 0.5]) and ssr < 1e-9
