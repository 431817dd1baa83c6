"""Cox partial likelihood, gradient and information against direct risk-set loops
(golden fixture: <= 400 rows, integer times 1-39 with heavy ties, 3 normal covariates)."""

import numpy as np
import pytest

from eventide.operators.cox import cox_fit, cox_partial_loglik
from eventide.operators.cox_grouped import cox_fit_grouped


@pytest.fixture(scope="module")
def golden(spark):
    rng = np.random.default_rng(42)
    n = 300
    X = rng.normal(size=(n, 3))
    T = rng.integers(1, 40, n).astype(float)
    E = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(i, float(T[i]), int(E[i]), *map(float, X[i])) for i in range(n)],
                               "id int, t double, e int, a double, b double, c double")
    return df, X, T, E


def direct(X, T, E, beta, ties):
    eta = X @ beta
    w = np.exp(eta)
    p = X.shape[1]
    ll, g, H = 0.0, np.zeros(p), np.zeros((p, p))
    for u in np.unique(T[E == 1]):
        R = T >= u
        D = (T == u) & (E == 1)
        d = D.sum()
        S0, S1 = w[R].sum(), (w[R, None] * X[R]).sum(0)
        S2 = np.einsum("i,ij,ik->jk", w[R], X[R], X[R])
        D0, D1 = w[D].sum(), (w[D, None] * X[D]).sum(0)
        D2 = np.einsum("i,ij,ik->jk", w[D], X[D], X[D])
        ll += eta[D].sum()
        g += X[D].sum(0)
        for k in range(d):
            f = k / d if ties == "efron" else 0.0
            z = S0 - f * D0
            m = (S1 - f * D1) / z
            ll -= np.log(z)
            g -= m
            H += (S2 - f * D2) / z - np.outer(m, m)
    return ll, g, H


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_loglik_gradient_information(golden, ties):
    df, X, T, E = golden
    beta = np.array([0.3, -0.2, 0.1])
    ll, g, H = cox_partial_loglik(df, "t", "e", ["a", "b", "c"], beta, ties)
    l2, g2, H2 = direct(X, T, E, beta, ties)
    assert abs(ll - l2) < 1e-9
    assert np.abs(g - g2).max() < 1e-9
    assert np.abs(H - H2).max() < 1e-9


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_fit_is_the_optimum(golden, ties):
    df, X, T, E = golden
    m = cox_fit(df, "t", "e", ["a", "b", "c"], ties=ties)
    _, g, H = direct(X, T, E, m.coef, ties)
    assert np.abs(g).max() < 1e-6
    assert np.allclose(np.sqrt(np.diag(np.linalg.inv(H))), m.se, rtol=1e-6)
    assert 0.0 < m.concordance < 1.0


def test_grouped_equals_single(golden):
    df, *_ = golden
    from pyspark.sql import functions as F
    g = df.withColumn("grp", (F.col("id") % 2).cast("int"))
    ms = cox_fit_grouped(g, "grp", "t", "e", ["a", "b", "c"])
    for k in (0, 1):
        one = cox_fit(g.where(F.col("grp") == k), "t", "e", ["a", "b", "c"], with_concordance=False)
        assert np.abs(ms[k].coef - one.coef).max() < 1e-8


def test_baseline_and_prediction(golden, spark):
    df, *_ = golden
    m = cox_fit(df, "t", "e", ["a", "b", "c"], with_concordance=False)
    s = m.predict_survival(df, [5.0, 20.0], keep=["id"]).collect()
    assert all(0.0 <= r["survival"] <= 1.0 for r in s)
    med = m.predict_median(df, "id").collect()
    assert len(med) == df.count()


def test_penalty_shrinks(golden):
    df, *_ = golden
    a = cox_fit(df, "t", "e", ["a", "b", "c"], with_concordance=False)
    b = cox_fit(df, "t", "e", ["a", "b", "c"], penalizer=0.5, with_concordance=False)
    assert np.abs(b.coef).sum() < np.abs(a.coef).sum()


def test_wide_cox_fits(spark):
    """40 covariates: no query grows with their square."""
    rng = np.random.default_rng(8)
    n, p = 600, 40
    x = rng.normal(size=(n, p))
    t = rng.exponential(np.exp(-(0.5 * x[:, 0] - 0.5 * x[:, 1])))
    df = spark.createDataFrame([(float(a), 1, *map(float, r)) for a, r in zip(t, x, strict=True)], ["t", "e", *[f"c{j}" for j in range(p)]])
    m = cox_fit(df, "t", "e", [f"c{j}" for j in range(p)], penalizer=0.01, with_concordance=False, ties="breslow", max_iter=3)
    assert m.coef[0] > 0.3 and m.coef[1] < -0.3 and np.abs(m.coef[2:]).max() < 0.25
