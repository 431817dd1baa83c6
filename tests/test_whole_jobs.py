"""Queries do the whole job that their method names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import competing as CR


@pytest.mark.parametrize("steps_each", [4, None])
def test_competing_predict_gives_risks_and_medians(spark, steps_each):
    """competing_predict gave CIFs and all-cause S alone; M17 also names S = prod S_k, risks and medians."""
    rng = np.random.default_rng(3)
    n = 120
    a = rng.normal(size=n)
    t = np.ceil(rng.exponential(8 * np.exp(-0.6 * a))) + 1
    cause = np.where(rng.random(n) < 0.8, 1, rng.integers(0, 3, n))
    rows = [(i, float(t[i]), int(cause[i]), float(a[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, t double, cause int, a double")
    models = CR.cause_specific_fit(df, "t", "cause", ["a"])
    odd = df.select("id", "a").unionByName(spark.createDataFrame([(0, 1.5), (500, None), (501, -9.0)], "id long, a double"))
    got = CR.competing_predict(models, odd, [3.0, 9.0], "id", steps_each).collect()
    assert len(got) == 2 * (n + 3)
    base = {k: sorted((r["time"], r["baseline_hazard"]) for r in m.baseline.collect()) for k, m in models.items()}
    grid = sorted({u for b in base.values() for u, _ in b})
    x = {(r["id"], r["a"]) for r in odd.collect()}
    for i, v in x:
        mine = [r for r in got if r["id"] == i and (v is None or abs(r["risk_1"] - math.exp((v - models[1].means[0]) * models[1].coef[0])) < 1e-9)]
        if v is None:
            assert len(mine) == 2 and all(r["risk"] is None and r["median_time"] is None and r["median_1"] is None for r in mine)
            continue
        risk = {k: math.exp((v - m.means[0]) * m.coef[0]) for k, m in models.items()}
        s, cif, before, found = 1.0, dict.fromkeys(models, 0.0), dict.fromkeys(models, 0.0), {}
        for u in grid:
            d = {k: risk[k] * (dict(base[k]).get(u, before[k]) - before[k]) for k in models}
            before = {k: dict(base[k]).get(u, before[k]) for k in models}
            for k in models:
                cif[k] += s * d[k]
                if cif[k] >= 0.5:
                    found.setdefault(f"median_{k}", u)
            s *= max(0.0, 1.0 - sum(d.values()))
            if s <= 0.5:
                found.setdefault("median_time", u)
        assert mine
        for r in mine:
            assert all(r[c] == found.get(c, math.inf) for c in ("median_time", "median_1", "median_2"))
            assert r["risk"] == pytest.approx(sum(risk.values()))
            s_k = {k: math.exp(-max((h for u, h in base[k] if u <= r["time"]), default=0.0) * risk[k]) for k in models}
            assert all(r[f"survival_{k}"] == pytest.approx(s_k[k]) for k in models)
            assert r["all_cause_survival"] == pytest.approx(math.prod(s_k.values()))
            assert r["survival"] + r["cif_1"] + r["cif_2"] == pytest.approx(1.0)
    assert len({r["median_1"] for r in got}) > 3 and math.inf in {r["median_2"] for r in got}


def test_frailty_predict_runs_all_rounds(spark, monkeypatch):
    """frailty_predict stopped after 5 EM rounds (default 30)."""
    from eventide.plans import q_models2 as Q
    asked = {}

    class Stop(Exception):
        pass

    def fit(*args, **options):
        asked.update(options)
        raise Stop

    monkeypatch.setattr(Q, "cox_data", lambda *a: (None, []))
    monkeypatch.setattr(Q, "frailty_fit", fit)
    with pytest.raises(Stop):
        Q.frailty_predict_q(spark, "")
    assert asked == {"cluster": "cluster"}


def test_tune_runs_all_trials_together(spark, monkeypatch):
    """tune stopped after 4 trials (default 50); Cox trials share their passes over the rows and give what single fits give."""
    from eventide.operators import train as TR
    from eventide.plans import q_train as Q
    asked = {}
    with monkeypatch.context() as patched:
        patched.setattr(Q, "cox_data", lambda *a: (None, []))
        patched.setattr(Q.TR, "tune", lambda *a, **options: asked.update(options))
        Q.tune_q(spark, "")
    assert asked == {"objective": "c_index"}
    rng = np.random.default_rng(5)
    n = 260
    x = rng.normal(size=(n, 2)).round(1)
    t = np.ceil(rng.exponential(9 * np.exp(-0.7 * x[:, 0])))
    df = spark.createDataFrame([(i, float(t[i]), int(rng.random() < 0.7), *map(float, x[i])) for i in range(n)], "id long, t double, e int, a double, b double").persist()
    space = {"penalizer": ("float", 1e-4, 1.0, "log"), "ties": ("categorical", ["efron", "breslow", "none"]), "l1_ratio": ("categorical", [0.0, 0.5])}
    run = lambda: {r["trial"]: r for r in TR.tune(df, "cox", space, "t", "e", ["a", "b"], objective="ibs", n_trials=6, grid_points=9).collect()}
    single, made = TR.make_model, []
    with monkeypatch.context() as patched:
        patched.setattr(TR, "make_model", lambda kind, **c: made.append(c["ties"]) or single(kind, **c))
        together = run()
    wrong = [i for i, c in enumerate(TR.sample_space(space, 6)) if c["ties"] == "none"]
    assert made == ["none"] * len(wrong) and 0 < len(wrong) < 5
    monkeypatch.setattr(TR, "_cox_trials", lambda *a: {})
    for i, r in run().items():
        got = together[i]
        assert got["params"] == r["params"] and (got["error"] or "")[:10] == (r["error"] or "")[:10] and (got["error"] is not None) == (i in wrong)
        assert i in wrong or np.allclose([got["c_index"], got["ibs"], got["objective"]], [r["c_index"], r["ibs"], r["objective"]], rtol=1e-6)
