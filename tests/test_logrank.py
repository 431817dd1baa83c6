"""k-sample log-rank with many groups against the dense formula."""
import numpy as np
import pytest

from eventide.operators.logrank import logrank, logrank_table


def _dense(t, e, g, k):
    o, x, V = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for u in np.unique(t[e == 1]):
        n = np.bincount(g[t >= u], minlength=k).astype(float)
        d = np.bincount(g[(t == u) & (e == 1)], minlength=k)
        N, D = n.sum(), d.sum()
        o, x, p = o + d, x + D * n / N, n / N
        if N > 1:
            V += D * (N - D) / (N - 1) * (np.diag(p) - np.outer(p, p))
    diff = (o - x)[:-1]
    return o, x, diff @ np.linalg.pinv(V[:-1, :-1], hermitian=True) @ diff


@pytest.mark.parametrize("k, counts_each", [(500, 300), (500, 200_000), (3, 7)])
def test_many_groups_equal_the_dense_formula(spark, k, counts_each):
    rng = np.random.default_rng(k)
    n = 6 * k + 60
    t, e, g = rng.integers(1, 90, n).astype(float), rng.integers(0, 2, n), np.append(np.arange(k), rng.integers(0, k, n - k))
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(t, e, g)] + [(3.0, 1, None)], "t double, e int, g int")
    o, x, stat = _dense(t, e, g, k)
    got = logrank(df, "g", counts_each=counts_each)
    assert got["groups"] == list(range(k)) and got["df"] == k - 1
    assert np.allclose(got["observed"], o) and np.allclose(got["expected"], x)
    assert got["statistic"] == pytest.approx(stat, rel=1e-8)
    table = {r["g"]: (r["observed"], r["expected"]) for r in logrank_table(df, "g", counts_each=counts_each).collect()}
    assert all(np.allclose(table[str(i)], (o[i], x[i])) for i in range(k))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "t double, e int, g string")
    assert logrank(empty, "g")["df"] == 0 and logrank_table(empty, "g").count() == 0
