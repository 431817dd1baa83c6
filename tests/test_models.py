"""Competing risks, AFT, frailty, additive and multi-state models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import competing as CR
from eventide.operators.aft import aft_fit


@pytest.fixture(scope="module")
def comp(spark):
    rng = np.random.default_rng(7)
    n = 300
    X = rng.normal(size=(n, 2))
    T = rng.integers(1, 30, n).astype(float)
    C = rng.integers(0, 3, n)
    df = spark.createDataFrame([(i, float(T[i]), int(C[i]), *map(float, X[i])) for i in range(n)],
                               "id int, t double, cause int, a double, b double")
    return df, X, T, C


def test_fine_gray_is_the_optimum(comp):
    df, X, T, C = comp
    m = CR.fine_gray_fit(df, "t", "cause", ["a", "b"], 1)
    G, g = {}, 1.0
    for u in np.unique(T):
        G[u] = g
        nr = (T >= u).sum()
        d = ((T == u) & (C != 0)).sum()
        c = ((T == u) & (C == 0)).sum()
        if nr - d > 0:
            g *= 1 - c / (nr - d)
    Gm = np.array([G[t] for t in T])

    def ll(beta):
        eta = X @ beta
        w = np.exp(eta)
        out = 0.0
        for u in np.unique(T[C == 1]):
            comp_ = (C == 2) & (T < u)
            S0 = w[T >= u].sum() + (G[u] * w[comp_] / Gm[comp_]).sum()
            D = (T == u) & (C == 1)
            out += eta[D].sum() - D.sum() * np.log(S0)
        return out

    assert abs(ll(m.coef) - m.loglik) < 1e-8
    eps = 1e-5
    grad = [(ll(m.coef + eps * np.eye(2)[k]) - ll(m.coef - eps * np.eye(2)[k])) / (2 * eps) for k in range(2)]
    assert max(abs(x) for x in grad) < 1e-5


def test_cause_specific_cif_plus_survival_is_one(comp):
    df, *_ = comp
    models = CR.cause_specific_fit(df, "t", "cause", ["a", "b"])
    out = CR.cause_specific_cif(models, df, [5.0, 15.0, 40.0], "id")
    dev = out.select(F.abs(F.col("survival") + F.col("cif_1") + F.col("cif_2") - 1.0).alias("d")) \
        .agg(F.max("d")).first()[0]
    assert dev < 1e-9


def test_weibull_aft_matches_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression
    rng = np.random.default_rng(11)
    n = 600
    X = rng.normal(size=(n, 2))
    T = np.exp(1 + 0.5 * X[:, 0] - 0.3 * X[:, 1] + 0.7 * np.log(rng.exponential(size=n)))
    E = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(float(T[i]), int(E[i]), *map(float, X[i])) for i in range(n)],
                               "t double, e int, a double, b double")
    m = aft_fit(df, "t", "e", ["a", "b"], "weibull", with_concordance=False)
    va = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df) \
        .withColumn("label", F.col("t")).withColumn("censor", F.col("e").cast("double"))
    sm = AFTSurvivalRegression(featuresCol="f", labelCol="label", censorCol="censor").fit(va)
    assert abs(m.intercept - sm.intercept) < 1e-5
    assert np.abs(m.coef - np.array(sm.coefficients)).max() < 1e-5
    assert abs(m.sigma - sm.scale) < 1e-5
    for d in ("lognormal", "loglogistic"):
        md = aft_fit(df, "t", "e", ["a", "b"], d, with_concordance=False)
        assert md.coef[0] > 0 > md.coef[1]


def test_frailty_and_additive(spark):
    from eventide.operators.additive import aalen_additive_fit
    from eventide.operators.frailty import frailty_fit
    rng = np.random.default_rng(2)
    rows = []
    z = rng.gamma(2.0, 0.5, 40)
    for k in range(40):
        for _ in range(8):
            x = rng.normal()
            t = rng.exponential(1 / (0.1 * z[k] * np.exp(0.7 * x)))
            c = rng.exponential(15)
            rows.append((k, float(min(t, c)), int(t <= c), float(x)))
    df = spark.createDataFrame(rows, "cl int, t double, e int, x double")
    m = frailty_fit(df, "t", "e", ["x"], "cl", max_em=6)
    assert 0.3 < m.cox.coef[0] < 1.2 and m.theta > 0
    a = aalen_additive_fit(df, "t", "e", ["x"])
    assert a.cumulative_coef.count() == df.where("e = 1").select("t").distinct().count()


def test_multi_state(spark):
    from eventide.operators.multistate import multi_state_fit
    from eventide.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    df = fx.journey(spark, SF_SMALL)
    m = multi_state_fit(df, ["value"])
    assert len(m.models) > 0
    p = m.predict(df, "id")
    assert p.count() == df.count()


def test_additive_matches_direct_solve(spark):
    from eventide.operators.additive import aalen_additive_fit
    rng = np.random.default_rng(8)
    n = 120
    x = rng.normal(size=n)
    t = rng.integers(1, 25, n).astype(float)
    e = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, x)], "t double, e int, x double")
    m = aalen_additive_fit(df, "t", "e", ["x"], coef_penalizer=0.5)
    got = {r["time"]: (r["B_intercept"], r["B_x"]) for r in m.cumulative_coef.collect()}
    B = np.zeros(2)
    for u in np.unique(t[e == 1]):
        R = t >= u
        Xr = np.column_stack([np.ones(R.sum()), x[R]])
        dN = ((t[R] == u) & (e[R] == 1)).astype(float)
        B = B + np.linalg.solve(Xr.T @ Xr + 0.5 * np.eye(2), Xr.T @ dN)
        assert np.allclose(got[u], B, atol=1e-10)


def test_grouped_two_level_scans_read_computed_tables(spark, monkeypatch):
    """Many times: the scans' tables are computed once a step (four times a scan, and one scan is on the other, before),
    with the same models."""
    from eventide.operators import cox_grouped as G
    from eventide.plans import fixtures as fx
    from tests.conftest import SF_SMALL
    df = fx.journey(spark, SF_SMALL).where("state IN ('click', 'view')").withColumn("value", F.coalesce("value", F.lit(0.0)))
    fit = lambda: G.cox_fit_grouped(df, "state", "t", "e", ["value"], penalizer=0.1)
    plain = fit()
    original, seen = G.cumulative, []
    monkeypatch.setattr(G, "cumulative", lambda table, *a, **kw: seen.append(table.is_cached) or original(table, *a, **kw))
    monkeypatch.setattr(G, "SINGLE_WINDOW_MAX_ROWS", 0)
    two = fit()
    assert seen and all(seen)
    assert plain.keys() == two.keys() and plain
    for k in plain:
        assert abs(plain[k].coef[0] - two[k].coef[0]) < 1e-9
        a, b = ({r["time"]: r["baseline_hazard"] for r in m.baseline.collect()} for m in (plain[k], two[k]))
        assert a.keys() == b.keys() and all(abs(a[t] - b[t]) < 1e-9 for t in a)
