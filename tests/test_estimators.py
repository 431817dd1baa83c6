"""Properties of Kaplan-Meier, log-rank and Aalen-Johansen."""

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import aj, logrank, risk
from eventide.plans import fixtures as fx
from tests.conftest import SF_MID


def test_km_monotone_and_bounded(spark):
    c = risk.kaplan_meier(fx.reorder(spark, SF_MID), strata="seg").orderBy("seg", "time").collect()
    by = {}
    for r in c:
        by.setdefault(r["seg"], []).append(r)
    for rows in by.values():
        s = [r["survival"] for r in rows]
        assert s[0] == 1.0
        assert all(0.0 <= x <= 1.0 for x in s)
        assert all(a >= b for a, b in zip(s, s[1:]))
        assert all(r["ci_lower"] <= r["survival"] + 1e-12 <= r["ci_upper"] + 2e-12 for r in rows)


def test_km_no_censoring_is_empirical(spark):
    t = [1.0, 2.0, 2.0, 3.0, 5.0, 5.0, 5.0, 8.0]
    df = spark.createDataFrame([(x, 1) for x in t], "t double, e int")
    c = {r["time"]: r["survival"] for r in risk.kaplan_meier(df, with_ci=False).collect()}
    for u, s in c.items():
        assert abs(s - sum(1 for x in t if x > u) / len(t)) < 1e-12


def test_single_stratum_equals_overall(spark):
    df = fx.reorder(spark, SF_MID).withColumn("one", F.lit("a"))
    a = {r["time"]: r["survival"] for r in risk.kaplan_meier(df, with_ci=False).collect()}
    b = {r["time"]: r["survival"] for r in risk.kaplan_meier(df, strata="one", with_ci=False).collect()}
    assert a == b


def test_logrank_identical_groups_is_zero(spark):
    df = fx.reorder(spark, SF_MID)
    dup = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    r = logrank.logrank(dup, "g")
    assert abs(r["statistic"]) < 1e-9
    assert r["p_value"] > 0.999


def test_logrank_two_sample_matches_direct(spark):
    rng = np.random.default_rng(4)
    n = 200
    t = rng.integers(1, 20, n).astype(float)
    e = rng.integers(0, 2, n)
    g = rng.integers(0, 2, n)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(t, e, g)], "t double, e int, g int")
    o = ex = v = 0.0
    for u in np.unique(t[e == 1]):
        R = t >= u
        n_, n1 = R.sum(), (R & (g == 0)).sum()
        d = ((t == u) & (e == 1)).sum()
        d1 = ((t == u) & (e == 1) & (g == 0)).sum()
        o += d1
        ex += d * n1 / n_
        if n_ > 1:
            v += d * (n1 / n_) * (1 - n1 / n_) * (n_ - d) / (n_ - 1)
    r = logrank.logrank(df, "g")
    assert abs(r["statistic"] - (o - ex) ** 2 / v) < 1e-9


def test_aalen_johansen_sums_to_one(spark):
    out = aj.aalen_johansen(fx.reorder(spark, SF_MID), "t", "cause")
    tot = out.groupBy("time").agg(F.sum("probability").alias("s")).agg(
        F.max(F.abs(F.col("s") - 1.0))).first()[0]
    assert tot < 1e-9


def test_period_metrics_grouped_equals_per_period(spark):
    from eventide.operators import metrics as M
    from eventide.operators import report as T
    df = fx.reorder(spark, SF_MID).withColumn("period", (F.col("id") % 3).cast("int")) \
        .withColumn("risk", F.col("price"))
    curves = risk.kaplan_meier(df, "t", "e", "seg", with_ci=False)
    pred = risk.km_predictions(df, curves, "seg", [180.0]).persist()
    got = {r["period"]: (r["brier"], r["auc"]) for r in T.period_metrics(pred, "period", 180.0, "S_0").collect()}
    for pv in range(3):
        part = pred.where(F.col("period") == pv)
        G = M.censoring_km(part)
        assert abs(M.brier_scores(part, [180.0], ["S_0"], "t", "e", G).first()["brier"] - got[pv][0]) < 1e-12
        assert abs(M.dynamic_auc(part, [180.0], "risk", "t", "e", G).first()["auc"] - got[pv][1]) < 1e-12
