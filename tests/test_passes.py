"""One-pass sums of the iterative fits against their row-by-row forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_tied_cox_step_equals_two_passes(spark, ties):
    from eventide.operators.cox import _step_stats, _tied_stats
    rng = np.random.default_rng(1)
    rows = [(float(rng.integers(1, 9)), int(rng.random() < 0.7), *map(float, rng.normal(size=3))) for _ in range(400)]
    X = spark.createDataFrame([*rows, (None, 1, 0.5, 0.5, 0.1)], "t double, e int, x0 double, x1 double, off double").repartition(3).persist()
    beta = np.array([0.3, -0.2])
    for offset in (False, True):
        one, two = _tied_stats(X, 2, beta, ties, offset), _step_stats(X, 2, beta, ties, False, 400, True, offset)
        for a, b in zip(one, two, strict=True):
            assert np.allclose(a, b, rtol=1e-10, atol=1e-9)
    X.unpersist()


def test_keyed_sums_pass_on_what_does_not_fit():
    from eventide.functions.sums import KeyedSums
    rng = np.random.default_rng(2)
    total, found = KeyedSums(max_groups=50), {}
    keys, values = rng.integers(0, 90, (1, 2000)).astype(float), rng.normal(size=(2, 2000))
    keys[0, ::7] = np.nan
    parts = [total.add(keys[:, a:a + 100], values[:, a:a + 100]) for a in range(0, 2000, 100)] + [total.rest()]
    for k, v in [p for p in parts if p is not None]:
        for i, key in enumerate(k[0]):
            found[str(key)] = found.get(str(key), 0.0) + v[:, i]
    for key in {str(k) for k in keys[0]}:
        assert np.allclose(found[key], values[:, [str(k) == key for k in keys[0]]].sum(axis=1))


def test_large_clusters_are_dealt_in_parts(spark):
    from eventide.operators.cox import _standardised
    from eventide.operators.frailty import _dealt
    df = spark.range(12000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("_cl"), (F.col("id") % 50 + 1.0).alias("t"),
                                   (F.col("id") % 2).cast("int").alias("e"), F.sin("id").alias("x"))
    rows = _standardised(df, "t", "e", ["x"], [F.col("_cl"), F.monotonically_increasing_id().alias("_row")])
    X, D, spread = _dealt(rows)
    sizes = X.groupBy("_cl", "_part").count().collect()
    assert sum(r["count"] for r in sizes) == 12000 and max(r["count"] for r in sizes) < 3000 and len(sizes) > 6
    z = spread(D.where("_cl is not null").select("_cl", "_parts", F.lit(0.5).alias("logz")))
    x = X.join(z, ["_cl", "_part"], "left")
    assert x.count() == 12000 and x.where("logz = 0.5").count() == 8000  # null clusters have no frailty


def test_loglik_sums_equal_sums_of_rows():
    from eventide.functions.special import erfc
    from eventide.operators.bayes import loglik_rows, loglik_sums
    z = np.concatenate([np.linspace(-7, 26, 3001), [0.46875, 4.0, -0.46875, -4.0, 0.0, np.inf, -np.inf]])
    assert np.allclose(erfc(z), [math.erfc(v) for v in z], rtol=1e-12, atol=1e-300) and np.isnan(erfc(np.array([np.nan])))[0]
    rng = np.random.default_rng(4)
    t, e, X = rng.exponential(30, 70) + 0.1, (rng.random(70) < 0.6).astype(float), rng.normal(size=(70, 2))
    for dist, d in (("weibull", 4), ("exponential", 3), ("lognormal", 4)):
        theta = rng.normal(size=(1500, d)) * 0.3
        for rows in (e, np.ones(70), np.zeros(70)):
            assert np.allclose(loglik_sums(theta, t, rows, X, dist), loglik_rows(theta, t, rows, X, dist).sum(axis=0), rtol=1e-11)


def test_neural_passes_equal_scores_by_row(spark):
    from eventide.functions import mlp
    from eventide.operators.neural import NeuralModel, _cox_gradient, _cox_time_table, _scored_by_time
    rng = np.random.default_rng(6)
    n = 300
    X, t, e, val = rng.normal(size=(n, 2)), rng.integers(1, 12, n).astype(float), rng.random(n) < 0.7, rng.random(n) < 0.2
    df = spark.createDataFrame([(i * 7919, float(t[i]), int(e[i]), bool(val[i]), *map(float, X[i])) for i in range(n)],
                               "_rk long, t double, e int, _val boolean, a double, b double").repartition(3)
    m = NeuralModel(["a", "b"], [5], "cox", mlp.init(2, [5], 1), np.zeros(2), np.ones(2))
    f = np.where(val, mlp.forward(m.theta, X, [5])[0], mlp.forward(m.theta, X, [5], False, 0.3, np.arange(n) * 7919, 9)[0])
    got = {(r["_val"], r["time"]): r for r in _scored_by_time(m, df, 0.3, 9).collect()}
    for fold, u in {(bool(v), u) for v, u in zip(val, t, strict=True)}:
        at = (val == fold) & (t == u)
        r = got[fold, u]
        assert np.allclose([r["d"], r["S0p"], r["ef"]], [e[at].sum(), np.exp(f[at]).sum(), (e * f)[at].sum()])
    tt, rows = _cox_time_table(_scored_by_time(m, df, 0.3, 9))
    tr = ~val
    A = np.array([sum(1.0 / np.exp(f[tr & (t >= t[j])]).sum() for j in np.flatnonzero(tr & e) if t[j] <= u) for u in t[tr]])
    _, cache = mlp.forward(m.theta, X[tr], [5], False, 0.3, np.arange(n)[tr] * 7919, 9)
    want, _ = mlp.backward(m.theta, X[tr], [5], cache, -(e[tr] - np.exp(f[tr]) * A))
    assert np.allclose(_cox_gradient(m, df.where("not _val"), tt, rows, 0.3, 9), want, rtol=1e-9, atol=1e-9)


def test_incidence_at_unsorted_times(spark):
    from eventide.operators import competing as CR
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(2, 40)), int(rng.integers(0, 3)), float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame([*rows, (200, 5.0, 1, None)], "id long, t double, c int, x double")
    models = CR.cause_specific_fit(df.where("x is not null"), "t", "c", ["x"])
    times = [30.0, 1.0, 12.5, 5.0]
    one, cut = ({(r["id"], r["time"]): r for r in CR.cause_specific_cif(models, df, times, "id", n).collect()} for n in (None, 7))
    assert len(one) == len(cut) == 201 * 4
    for (i, t), r in one.items():
        if i < 200:
            assert abs(r["survival"] + r["cif_1"] + r["cif_2"] - 1.0) < 1e-12
            assert all(abs(r[c] - cut[i, t][c]) < 1e-12 for c in ("survival", "cif_1", "cif_2"))
        if t < 2:  # before the first step
            assert (r["survival"], r["cif_1"], r["cif_2"]) == (1.0, 0.0, 0.0)
