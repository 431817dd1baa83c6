"""Many Cox models over sorted blocks equal the sums over risk sets, wherever blocks are cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import cox_sorted as S
from eventide.operators.multistate import multi_state_fit


def _plain(rows, beta, label, efron):
    """Log likelihood, gradient, information and {time: hazard increment} of one model, by loops; rows: (t, lab, x)."""
    p = len(beta)
    ll, g, H, dh = 0.0, np.zeros(p), np.zeros((p, p)), {}
    for u in sorted({t for t, _, _ in rows}):
        risk = [np.array(x) for t, _, x in rows if t >= u and None not in x]
        events = [(x, None not in x) for t, lab, x in rows if t == u and lab == label]
        at = [np.array(x) for x, ok in events if ok]
        d = len(events)
        w = [math.exp(x @ beta) for x in risk]
        dh[u] = d / sum(w) if d else 0.0
        if not d or not any(t == u and None not in x for t, _, x in rows):
            continue
        mom = lambda xs: (sum(math.exp(x @ beta) for x in xs), sum((math.exp(x @ beta) * x for x in xs), np.zeros(p)),
                          sum((math.exp(x @ beta) * np.outer(x, x) for x in xs), np.zeros((p, p))))
        (S0, S1, S2), (D0, D1, D2) = mom(risk), mom(at)
        for x in at:
            ll += x @ beta
            g += x
        for k in range(d):
            f = k / d if efron else 0.0
            z = S0 - f * D0
            m = (S1 - f * D1) / z
            ll -= math.log(z)
            g -= m
            H += (S2 - f * D2) / z - np.outer(m, m)
    return ll, g, H, dh


@pytest.mark.parametrize("block,terms", [(3, 2), (7, 1_000_000), (1000, 1_000_000)])
def test_blocks_equal_loops_over_risk_sets(spark, monkeypatch, block, terms):
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    monkeypatch.setattr(S, "TIE_TERMS", terms)
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 2)), float(rng.choice([1, 2, 2, 2, 5, 9, rng.random()])), int(rng.integers(-1, 3)),
             None if i % 13 == 0 else float(rng.normal()), float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame(rows, "s int, t double, lab int, x0 double, x1 double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
    of = [(0, 0, True), (0, 2, False), (1, 0, True), (1, 1, True)]
    try:
        got = S.sorted_rows(df, 2, 150, of)
        betas = {0: np.array([0.3, -0.2]), 1: np.array([0.5, 0.1]), 3: np.array([-0.4, 0.2])}
        stats = got.stats(betas)
        at, curves = got.hazard_at(betas, [0.0, 2.0, 99.0]), got.curves(betas)
        table = {(r["g"], r["time"]): r["baseline_hazard"] for r in got.hazard_table(betas, {0: "a", 1: "b", 3: "c"}).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert stats.keys() == betas.keys() and (block == 1000 or got.blocks.count() > 20)
    for m, beta in betas.items():
        s, label, efron = of[m]
        mine = [(t, lab, (a, b)) for k, t, lab, a, b in rows if k == s]
        ll, g, H, dh = _plain(mine, beta, label, efron)
        assert stats[m][0] == pytest.approx(ll, abs=1e-9) and np.allclose(stats[m][1], g, atol=1e-9) and np.allclose(stats[m][2], H, atol=1e-9)
        assert stats[m][3:] == (len(mine), sum(lab == label for _, lab, _ in mine))
        total = np.cumsum([dh[u] for u in sorted(dh)])
        for u, h in zip(sorted(dh), total, strict=True):
            assert table["abc"[[0, 1, 3].index(m)], u] == pytest.approx(h)
        assert np.allclose(at[m], [sum(v for u, v in dh.items() if u <= x) for x in (0.0, 2.0, 99.0)])
        some = [u for u in sorted(dh) if dh[u] > 0]
        assert curves[m][0].tolist() == some and np.allclose(curves[m][1], np.cumsum([dh[u] for u in some]))
    assert len(table) == sum(len({t for k, t, *_ in rows if k == of[m][0]}) for m in betas)


def test_newton_finds_the_grouped_fits(spark):
    """Exits of a state share its sorted rows (rows were copied once an exit before); the models are those of the grouped fit,
    and predictions need no as-of join over copies of the rows."""
    from eventide.operators.cox_grouped import cox_fit_grouped
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], [None, "a", "b", "c"][int(rng.integers(0, 4))], float(np.ceil(rng.exponential(9) * 2) / 2), float(rng.normal()))
            for i in range(400)] + [(400, "d", None, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, state string, next_state string, t double, value double")
    m = multi_state_fit(df, ["value"])
    assert sorted(m.models) == [f"{a}->{b}" for a in "ab" for b in "abc"] and m.states == list("abcd")
    sizes = m._rows[0].blocks.select(F.length("t") / 8).collect()
    assert sum(r[0] for r in sizes) == 400  # not rows x exits
    edges = spark.createDataFrame([(a, b, f"{a}->{b}") for a in "ab" for b in "abc"], "state string, d string, tr string")
    x = df.join(edges, "state").withColumn("e", F.coalesce(F.col("next_state") == F.col("d"), F.lit(False)).cast("int"))
    old = cox_fit_grouped(x, "tr", "t", "e", ["value"], penalizer=0.1)
    for k, o in old.items():
        n = m.models[k]
        assert np.allclose([n.coef[0], n.se[0], n.loglik, n.loglik_null, n.n, n.events], [o.coef[0], o.se[0], o.loglik, o.loglik_null, o.n, o.events], atol=1e-8)
        base = {r["time"]: r["baseline_hazard"] for r in o.baseline.collect()}
        got = {r["time"]: r["baseline_hazard"] for r in n.baseline.collect()}
        assert base.keys() == got.keys() and all(got[u] == pytest.approx(h, abs=1e-9) for u, h in base.items())
    # rows with one key answer together, as they did; a state without exits has no answer
    twice = df.withColumn("id", F.floor(F.col("id") / 2))
    held = m.predict(twice, "id")
    assert "Window" not in held._jdf.queryExecution().optimizedPlan().toString()
    held = {r["id"]: (r["risk"], r["median_time"]) for r in held.collect()}
    surv = {(r["id"], r["transition"], r["time"]): r["survival"] for r in m.predict_survival(df, "id", [1.0, 4.0]).collect()}
    m._rows = None
    plain = {r["id"]: (r["risk"], r["median_time"]) for r in m.predict(twice, "id").collect()}
    assert held.keys() == plain.keys() and len(held) == 200
    assert all(np.allclose(held[k], plain[k], equal_nan=True) for k in held) and len({v[1] for v in held.values()}) > 2
    old = {(r["id"], r["transition"], r["time"]): r["survival"] for r in m.predict_survival(df, "id", [1.0, 4.0]).collect()}
    assert old.keys() == surv.keys() and all(surv[k] == pytest.approx(v) for k, v in old.items())
