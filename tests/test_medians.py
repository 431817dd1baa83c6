"""Cumulative incidence without a driver grid and medians over all event times, against plain loops."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import competing as CR
from eventide.operators.medians import event_times, first_at_level


@pytest.fixture(scope="module")
def comp(spark):
    rng = np.random.default_rng(5)
    n = 160
    X = rng.normal(size=(n, 2)).round(1)
    T = rng.integers(1, 40, n).astype(float)
    C = rng.choice([0, 1, 2], n, p=[0.2, 0.5, 0.3])
    return spark.createDataFrame([(i, float(T[i]), int(C[i]), int(C[i] > 0), *map(float, X[i])) for i in range(n)],
                                 "id int, t double, cause int, e int, a double, b double").persist()


def _plain(models, df):
    """id -> (times, survival, {cause: cif}) over every baseline step."""
    causes = sorted(models)
    base = {k: {r["time"]: r["baseline_hazard"] for r in models[k].baseline.collect()} for k in causes}
    grid = sorted(set().union(*base.values()))
    lps = df.select("id", *[models[k].linear_predictor(df).alias(f"lp{k}") for k in causes]).collect()
    out = {}
    for r in lps:
        s, h, cif, S, C = 1.0, dict.fromkeys(causes, 0.0), dict.fromkeys(causes, 0.0), [], []
        for t in grid:
            d = {k: math.exp(r[f"lp{k}"]) * (base[k].get(t, h[k]) - h[k]) for k in causes}
            h = {k: base[k].get(t, h[k]) for k in causes}
            cif = {k: cif[k] + s * d[k] for k in causes}
            s *= max(0.0, 1.0 - sum(d.values()))
            S.append(s)
            C.append(cif)
        out[r["id"]] = (np.array(grid), np.array(S), C)
    return out


@pytest.mark.parametrize("steps_each", [4, None])
def test_cif_and_median_equal_the_loop_over_all_steps(comp, steps_each):
    models = CR.cause_specific_fit(comp, "t", "cause", ["a", "b"])
    plain = _plain(models, comp)
    times = [0.5, 7.0, 7.5, 30.0, 99.0]
    got = CR.cause_specific_cif(models, comp, times, "id", steps_each=steps_each).collect()
    assert len(got) == len(plain) * len(times)
    for r in got:
        grid, S, C = plain[r["id"]]
        i = int(np.searchsorted(grid, r["time"], side="right")) - 1
        assert r["survival"] == pytest.approx(S[i] if i >= 0 else 1.0, abs=1e-12)
        for k in models:
            assert r[f"cif_{k}"] == pytest.approx(C[i][k] if i >= 0 else 0.0, abs=1e-12)
    medians = {r["id"]: r["median_time"] for r in CR.cause_specific_median(models, comp, "id", steps_each=steps_each).collect()}
    for i, (grid, S, _) in plain.items():
        assert medians[i] == (grid[S <= 0.5][0] if (S <= 0.5).any() else math.inf)


def test_cif_odd_rows(spark, comp):
    models = CR.cause_specific_fit(comp, "t", "cause", ["a", "b"])
    odd = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 1.0), (3, 50.0, 50.0)], "id int, a double, b double")
    got = CR.cause_specific_cif(models, odd, [3.0, 3.0], "id").groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 4, 2: 2, 3: 2}
    medians = CR.cause_specific_median(models, odd, "id", steps_each=5).collect()
    assert [r["median_time"] is None for r in medians if r["id"] == 2] == [True] and len(medians) == 4
    assert CR.cause_specific_cif(models, odd.limit(0), [3.0], "id").count() == 0
    early = CR.cause_specific_cif(models, odd, [-1.0], "id").collect()
    assert len(early) == 4 and all(r["survival"] == 1.0 and r["cif_1"] == 0.0 for r in early)


@pytest.mark.parametrize("kind", ["forest", "bayes"])
def test_median_search_equals_scan_of_all_times(comp, kind):
    if kind == "forest":
        from eventide.operators.forest import rsf_fit
        model = rsf_fit(comp, "t", "e", ["a", "b"], "id", n_estimators=5, min_samples_leaf=4)
    else:
        from eventide.operators.bayes import bayes_fit
        model = bayes_fit(comp, "t", "e", ["a", "b"], "id", draws=40, chains=1, tune=40, with_waic=False)
    times = event_times(comp, "t", "e")
    every = sorted(r["time"] for r in times.collect())
    scan = model.predict_survival(comp, every, ["id"]).groupBy("id").agg(
        F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))), F.lit(math.inf)).alias("m"))
    want = {r["id"]: r["m"] for r in scan.collect()}
    for ways in (3, 64):  # four rounds, one round
        got = first_at_level(comp.select("id", "a", "b"), "id", times, model.survival_at, ways=ways)
        assert {r["id"]: r["median_time"] for r in got.collect()} == want
    none = first_at_level(comp.select("id", "a", "b"), "id", times.limit(0), model.survival_at)
    assert none.where("median_time = double('inf')").count() == comp.count()
