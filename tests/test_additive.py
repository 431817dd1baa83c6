"""Additive hazards: smoothing against the sequential loop, medians against a scan of all event times."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import additive


def _data(spark, n=300, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(1 / (0.05 + 0.03 * (x[:, 0] > 0))) * 4) / 4 + 0.25
    e = (rng.random(n) < 0.7).astype(int)
    return x, t, e, spark.createDataFrame([(i, float(t[i]), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)],
                                          "id int, t double, e int, a double, b double")


def _loop(x, t, e, ridge, smooth):
    z = np.column_stack([np.ones(len(t)), x])
    step, out = np.zeros(3), {}
    for s in sorted(set(t[e == 1])):
        risk = t >= s
        step = np.linalg.solve(z[risk].T @ z[risk] + (ridge + smooth) * np.eye(3), z[(t == s) & (e == 1)].sum(axis=0) + smooth * step)
        out[s] = step
    return out


@pytest.mark.parametrize("bucket", [50_000, 9])
@pytest.mark.parametrize("smooth", [0.0, 2.0, 40.0])
def test_steps_equal_the_loop(spark, monkeypatch, bucket, smooth):
    monkeypatch.setattr(additive.smoothed_steps, "__defaults__", (bucket,))
    x, t, e, df = _data(spark)
    got = {r["time"]: [r["dB_intercept"], r["dB_a"], r["dB_b"]] for r in additive.aalen_additive_fit(df, "t", "e", ["a", "b"], 0.5, smooth).cumulative_coef.collect()}
    want = _loop(x, t, e, 0.5, smooth)
    assert got.keys() == want.keys() and all(np.allclose(got[s], want[s], atol=1e-9) for s in want)


@pytest.mark.parametrize("bucket", [2048, 7])
def test_medians_equal_a_scan_of_all_times(spark, monkeypatch, bucket):
    monkeypatch.setattr(additive.first_crossing, "__defaults__", (bucket,))
    monkeypatch.setattr(additive, "CROSSING_ROWS", 100)
    x, t, e, df = _data(spark)
    m = additive.aalen_additive_fit(df, "t", "e", ["a", "b"], 0.5)
    curve = sorted((r["time"], r["B_intercept"], r["B_a"], r["B_b"]) for r in m.cumulative_coef.collect())
    got = {r["id"]: (r["risk"], r["median_time"]) for r in additive.additive_risk(m, df, ["id"]).collect()}
    never = {r["id"] for r in additive.additive_risk(m, df, ["id"], never=math.inf).where(F.col("median_time") == math.inf).collect()}
    assert len(got) == 300
    fell = False
    for i in range(300):
        h = [b0 + x[i, 0] * b1 + x[i, 1] * b2 for _, b0, b1, b2 in curve]
        cross = next((s for (s, *_), v in zip(curve, h) if v >= math.log(2.0)), None)
        assert got[i][1] == (curve[-1][0] if cross is None else cross) and (i in never) == (cross is None)
        assert abs(got[i][0] - h[-1]) < 1e-9
        fell |= any(b < a for a, b in zip(h, h[1:]))
    assert fell  # hazards here do fall, so a search that takes them as rising would not do


def test_missing_features_and_no_events(spark):
    _, _, _, df = _data(spark, 60)
    m = additive.aalen_additive_fit(df, "t", "e", ["a", "b"], 0.5)
    odd = df.withColumn("a", F.when(F.col("id") > 3, F.col("a")))
    rows = {r["id"]: r["median_time"] for r in additive.additive_risk(m, odd, ["id"], never=-1.0).collect()}
    assert len(rows) == 60 and rows[0] == -1.0
