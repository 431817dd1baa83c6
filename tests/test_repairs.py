"""One answer at any size, predictions past time 100, and results that do not hang on re-evaluation."""

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.functions import mlp
from eventide.operators import clean, features, profile, quantiles, report, split
from eventide.operators.factory import make_model
from eventide.plans import fixtures as fx
from eventide.plans import scan


@pytest.fixture(scope="module")
def data(spark):
    return fx.reorder(spark, "/root/testdata/sf0.001").select("id", "seg", "price", "t", "e").persist()


@pytest.mark.parametrize("limit", [1, 10**12])
def test_quantiles_are_exact_in_both_forms(spark, data, monkeypatch, limit):
    monkeypatch.setattr(scan, "SINGLE_WINDOW_MAX_ROWS", limit)
    monkeypatch.setattr(scan, "ROWS_PER_BUCKET", 300)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.column_quantiles(data, ["price", "t"], probs)
    for c in ("price", "t"):
        x = [r[0] for r in data.select(F.col(c).cast("double")).collect()]
        assert np.allclose(got[c], np.quantile(x, probs), rtol=1e-12)
    by = {r.seg: r.q0_0 for r in quantiles.exact_quantiles(data, ["price"], [0.5], by="seg").collect()}
    want = {r.seg: r.m for r in data.groupBy("seg").agg(F.median("price").alias("m")).collect()}
    assert by.keys() == want.keys() and all(math.isclose(by[k], want[k]) for k in by)
    lo, hi = report.risk_thresholds(data, "price")
    assert (lo, hi) == tuple(quantiles.column_quantiles(data, ["price"], [0.25, 0.75])["price"])


def test_quantiles_of_nulls_nan_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 2.0, None), (2, None, None), (None, 5.0, None)], "g int, x double, y double")
    assert quantiles.column_quantiles(df, ["x", "y"], [0.5, 1.0]) == {"x": [2.0, 5.0], "y": [None, None]}
    assert quantiles.column_quantiles(df.limit(0), ["x"], [0.5]) == {"x": [None]}
    got = {r.g: r.q0_0 for r in quantiles.exact_quantiles(df, ["x"], [0.5], by="g").collect()}
    assert got == {1: 2.0, None: 5.0}
    stats = {r.column_name: r for r in profile.column_stats(df).collect()}
    assert stats["x"].median == 2.0 and stats["y"].median is None and stats["x"].n_distinct == 2


def test_wide_tables_lose_no_features(spark):
    df = spark.createDataFrame([tuple(float(i * k) for i in range(1, 13)) for k in (1, 2)], [f"c{i:02d}" for i in range(12)])
    assert len(features.pairwise_features(df).columns) == 12 + 3 * 66
    assert len(features.pairwise_features(df, max_features=features.MAX_PAIRWISE).columns) == 12 + 20
    assert len(features.interaction_features(df).columns) == 12 + 66
    assert len(features.polynomial_features(df).columns) == 24
    assert len(features.series_features(df).columns) == 12 + 120


def test_dense_rank_without_exchange_reuse(spark):
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        values = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("v")).repartition(13)
        got = split.sorted_dense_rank(values, "v", 16)
        assert got.where(F.col("rank") != F.col("v") + 1).count() == 0 and got.count() == 20_000
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_landing_checkpoint_has_one_name_in_every_process(tmp_path):
    code = f"from eventide.streaming.landing import _name; print(_name({str(tmp_path)!r}), _name('file:{tmp_path}/'))"
    names = {x for seed in "12" for x in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True,
                                                       env={"PYTHONHASHSEED": seed, "PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(sys.path)}).stdout.split()}
    assert len(names) == 1


def test_event_with_a_third_value_among_nulls_is_refused(spark):
    df = spark.createDataFrame([(None,), (0,), (2,), (1,)], "e int")
    with pytest.raises(ValueError, match="more than two"):
        clean.encode_event(df, "e")
    ok = clean.encode_event(spark.createDataFrame([(None,), (5,), (2,)], "e int"), "e")
    assert sorted(ok.collect(), key=repr) == [(0,), (1,), (None,)]


def test_dropout_masks_follow_the_row(spark):
    rng = np.random.default_rng(0)
    theta = rng.normal(0, 0.5, len(mlp.init(3, [8, 4], 1)))
    X, keys = rng.normal(size=(40, 3)), rng.integers(-2**62, 2**62, 40)
    f, cache = mlp.forward(theta, X, [8, 4], False, 0.4, keys, 5)
    order = rng.permutation(40)
    assert np.allclose(mlp.forward(theta, X[order], [8, 4], False, 0.4, keys[order], 5)[0], f[order])
    assert not np.allclose(mlp.forward(theta, X, [8, 4], False, 0.4, keys, 6)[0], f)
    assert abs(np.mean([m is not None and (m == 0).mean() for _, m in cache[1]]) - 0.4) < 0.1
    g = rng.normal(size=40)
    grad, _ = mlp.backward(theta, X, [8, 4], cache, g, False)
    num = np.array([(g @ mlp.forward(theta + d, X, [8, 4], False, 0.4, keys, 5)[0] - g @ mlp.forward(theta - d, X, [8, 4], False, 0.4, keys, 5)[0]) / 2e-6
                    for d in np.eye(len(theta)) * 1e-6])
    assert np.allclose(grad, num, atol=1e-5)


def test_first_purchase_keeps_and_censors_everybody(spark):
    sf = "/root/testdata/sf0.001"
    got = fx.first_purchase(spark, sf)
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
    assert got.count() == users and got.where("t is null or e is null or t < 0 or t > 24").count() == 0


KINDS = {"cox_ph": {}, "aft": {}, "aalen_additive": {}, "frailty": {"cluster": "seg", "max_em": 2}, "gradient_boosting": {"n_estimators": 5},
         "random_survival_forest": {"n_estimators": 4, "max_depth": 2}, "deepsurv": {"epochs": 3}, "neural": {"epochs": 3}, "kaplan_meier": {}}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_median_agrees_with_survival_past_time_100(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), "ab"[i % 2], float(200 + rng.exponential(300) * math.exp(-0.5 * x)), int(rng.random() < 0.8))
            for i, x in enumerate(rng.normal(size=160))]
    df = spark.createDataFrame(rows, "id long, x double, seg string, t double, e int").persist()
    est = make_model(kind, **KINDS[kind]).fit(df, "t", "e", ["x"], "id")
    assert est.predict_risk(df, ["id"]).count() == 160
    med = {r.id: r.median_time for r in est.predict_median(df, "id").collect()}
    assert len(med) == 160 and sum(math.isfinite(m) for m in med.values()) > 100 and min(med.values()) > 100
    if kind != "aft":
        times = sorted({r[3] for r in rows if r[4]})[::8]
        s = {(r.id, r.time): r.survival for r in est.predict_survival(df, times, ["id"]).collect()}
        if kind != "aalen_additive":  # its survival need not be monotone
            assert all((s[i, t] <= 0.5) == (t >= m) for i, m in med.items() for t in times if abs(t - m) > 1e-6)


def test_frailty_without_a_cluster_column(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(x), float(rng.exponential(50) + 1), 1) for i, x in enumerate(rng.normal(size=60))], "id long, x double, t double, e int")
    est = make_model("frailty", max_em=2).fit(df, "t", "e", ["x"], "id")
    assert est.predict_survival(df, [10.0, 50.0], ["id"]).count() == 120 and est.predict_median(df, "id").count() == 60
