"""Robust Cox variance with heavy ties against the direct loop over events."""
import numpy as np
import pytest

from eventide.operators.cox import cox_fit, robust_variance


def _residuals(t, e, X, beta, efron):
    w, U = np.exp(X @ beta), np.zeros_like(X)
    for u in np.unique(t[e == 1]):
        risk, dead = t >= u, (t == u) & (e == 1)
        d = int(dead.sum())
        for k in range(d):
            f = k / d if efron else 0.0
            share = np.where(dead, 1.0 - f, 1.0) * risk * w
            z = share.sum()
            mean = share @ X / z
            U[dead] += (X[dead] - mean) / d
            U -= share[:, None] * (X - mean) / z
    return U


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_robust_variance_equals_the_loop(spark, ties):
    rng = np.random.default_rng(2)
    n = 240
    X = rng.normal(size=(n, 2))
    t, e, cl = rng.integers(1, 9, n).astype(float), rng.integers(0, 2, n), rng.integers(0, 30, n)
    df = spark.createDataFrame([(float(a), int(b), int(c), *map(float, x)) for a, b, c, x in zip(t, e, cl, X)],
                               "t double, e int, cl int, a double, b double")
    m = cox_fit(df, "t", "e", ["a", "b"], ties=ties, with_concordance=False)
    U = _residuals(t, e, X - m.means, m.coef, ties == "efron")
    assert np.allclose(U.sum(axis=0), 0.0, atol=1e-5)  # the score at the fit
    assert np.allclose(robust_variance(m, df, "t", "e"), m.variance @ (U.T @ U) @ m.variance, rtol=1e-8)
    by = np.zeros((30, 2))
    np.add.at(by, cl, U)
    assert np.allclose(robust_variance(m, df, "t", "e", cluster="cl"), m.variance @ (by.T @ by) @ m.variance, rtol=1e-8)
