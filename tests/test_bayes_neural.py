"""Markov chains against a 1-D numerical posterior; MLP gradients; neural fits run."""

import math

import numpy as np

from eventide.functions import mlp


def test_chains_match_exact_posterior(spark):
    from eventide.operators.bayes import bayes_fit
    rng = np.random.default_rng(3)
    n = 1500
    t = rng.exponential(20.0, n)
    c = rng.exponential(40.0, n)
    T, E = np.minimum(t, c), (t <= c).astype(int)
    df = spark.createDataFrame([(i, float(T[i]), int(E[i])) for i in range(n)], "id int, t double, e int")
    m = bayes_fit(df, "t", "e", [], "id", "exponential", draws=1500, tune=500)
    g = np.linspace(-6, -1, 20001)
    lp = E.sum() * g - np.exp(g) * T.sum() - g * g / 8.0
    w = np.exp(lp - lp.max())
    mean = (w * g).sum() / w.sum()
    sd = math.sqrt((w * (g - mean) ** 2).sum() / w.sum())
    assert abs(m.draws[:, 0].mean() - mean) < 0.2 * sd
    assert abs(m.draws[:, 0].std() - sd) < 0.15 * sd
    again = bayes_fit(df.repartition(7), "t", "e", [], "id", "exponential", draws=1500, tune=500, with_waic=False)
    assert abs(again.draws[:, 0].mean() - m.draws[:, 0].mean()) < 1e-3 * sd  # partitions change nothing


def test_posterior_does_not_hang_on_the_size(spark):
    """Ten copies of the rows: the same mode, a tenth of the variance."""
    from eventide.operators.bayes import bayes_fit
    rng = np.random.default_rng(5)
    x = rng.normal(size=800)
    t = 50 * rng.weibull(1.5, 800) * np.exp(-0.4 * x)
    rows = [(i, float(a), float(b), int(i % 5 > 0)) for i, (a, b) in enumerate(zip(x, t, strict=True))]
    df = spark.createDataFrame(rows, "id int, x double, t double, e int")
    few = bayes_fit(df, "t", "e", ["x"], "id", with_waic=False, prior_sigma=100.0)
    many = bayes_fit(df.crossJoin(spark.range(10).select("id").withColumnRenamed("id", "copy")), "t", "e", ["x"], "id", with_waic=False, prior_sigma=100.0)
    sd = few.draws.std(axis=0)
    assert np.abs(few.draws.mean(axis=0) - many.draws.mean(axis=0)).max() < 0.15 * sd.max() + 0.15 * sd.min()
    assert np.allclose(many.draws.std(axis=0), sd / math.sqrt(10), rtol=0.15)


def test_mlp_gradients():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(15, 3))
    g = rng.normal(size=15)
    for hidden, res in (([5, 4], False), ([5, 5], True)):
        th = mlp.init(3, hidden, 1)
        f, cache = mlp.forward(th, X, hidden, res)
        gp, dx = mlp.backward(th, X, hidden, cache, g, res, True)
        num = np.zeros_like(th)
        for i in range(len(th)):
            a, b = th.copy(), th.copy()
            a[i] += 1e-6
            b[i] -= 1e-6
            num[i] = (g @ mlp.forward(a, X, hidden, res)[0] - g @ mlp.forward(b, X, hidden, res)[0]) / 2e-6
        assert np.abs(num - gp).max() < 1e-6


def test_neural_and_boost_run(spark):
    from eventide.operators.boost import boost_fit
    from eventide.operators.neural import discrete_fit, neural_fit
    from eventide.plans.q_models import cox_data
    from tests.conftest import SF_SMALL
    data, feats = cox_data(spark, SF_SMALL)
    m = neural_fit(data, "t", "e", feats, "id", "cox", hidden=(8,), epochs=3)
    assert m.score(data, ["id"]).count() == data.count()
    p = neural_fit(data, "t", "e", feats, "id", "parametric", hidden=(8,), epochs=3)
    s = p.predict_survival(data, [30.0, 300.0], ["id"]).collect()
    assert all(0.0 <= r["survival"] <= 1.0 for r in s)
    d = discrete_fit(data, "t", "e", feats, 5, (4,), 20)
    assert d.predict_risk(data, "id").count() == data.count()
    b = boost_fit(data, "t", "e", feats, "id", n_estimators=3)
    assert b.score(data, ["id"]).count() == data.count()
