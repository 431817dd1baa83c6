"""Competing risks and multi-state models through the factory, and full training output."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators import train as TR
from eventide.operators.aft import aft_fit
from eventide.operators.factory import make_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=300)
    t1, t2, c = rng.exponential(200 * np.exp(-0.8 * x)), rng.exponential(300, 300), rng.exponential(400, 300)
    t = np.minimum(np.minimum(t1, t2), c) + 1
    cause = np.where(t1 + 1 == t, 1, np.where(t2 + 1 == t, 2, 0))
    data = [(i, float(x[i]), float(np.ceil(t[i])), int(cause[i]), int(cause[i] == 1), "ab"[i % 2], {0: None, 1: "c", 2: "d"}[int(cause[i])])
            for i in range(300)]
    return spark.createDataFrame(data, "id long, x double, t double, cause int, e int, state string, next_state string").persist()


@pytest.mark.parametrize("kind,params", [("competing_risks", {}), ("competing_risks", {"method": "fine_gray"}), ("multi_state", {}),
                                         ("kaplan_meier", {"stratify_by": "state"})])
def test_factory_kinds(rows, kind, params):
    est = make_model(kind, **params).fit(rows, "t", "e", ["x"], "id")
    risk = {r.id: r.risk for r in est.predict_risk(rows, ["id"]).collect()}
    s = {(r.id, r.time): r.survival for r in est.predict_survival(rows, [50.0, 200.0], ["id"]).collect()}
    assert len(risk) == 300 and len(s) == 600
    assert all(0 <= s[i, 200.0] <= s[i, 50.0] <= 1 for i in risk)
    assert est.predict_median(rows, "id").count() == 300
    if kind == "competing_risks":
        xs = {r.id: r.x for r in rows.collect()}
        order = sorted(risk, key=risk.get)
        assert xs[order[0]] < xs[order[-1]]  # larger x: earlier events of cause 1
        assert est.feature_importance(rows.sparkSession).first().feature == "x"


def test_training_output(spark, rows):
    ids = rows.select("id").where("id % 4 = 0")
    out = TR.train(rows, {"kind": "cox_ph", "cv": 3, "test_ids": ids, "n_boot": 10, "grid_points": 10}, "t", "e", ["x"])
    m = out["metrics"].first()
    assert m.n_test == 75 and m.c_index_lower <= m.c_index <= m.c_index_upper and 0 <= m.ibs <= 1 and m.training_seconds > 0
    assert 0.5 < m.integrated_auc <= 1
    at = out["at_times"].collect()
    assert len(at) == 5 and all(0 <= r.brier <= 1 and 0 <= r.auc <= 1 for r in at)
    assert out["folds"].where("fold >= 0").count() == 3


def test_aft_l1_shrinks_to_zero(rows):
    x = rows.withColumn("noise", F.col("id") % 7 - 3.0)
    plain = aft_fit(x, "t", "e", ["x", "noise"], with_concordance=False)
    lasso = aft_fit(x, "t", "e", ["x", "noise"], penalizer=0.2, l1_ratio=1.0, with_concordance=False)
    ridge = aft_fit(x, "t", "e", ["x", "noise"], penalizer=0.2, l1_ratio=0.0, with_concordance=False)
    assert abs(lasso.coef[1]) < 1e-2 < abs(plain.coef[0]) and abs(lasso.coef[0]) < abs(plain.coef[0]) and abs(ridge.coef[0]) < abs(plain.coef[0])
    assert math.isfinite(lasso.loglik)


def test_brier_of_joins_outcomes_before_predictions(spark):
    """Same scores as over the long predictions, and the outcomes are joined to the rows: the plan has no
    join above the explode (rows x horizons were shuffled or broadcast before)."""
    from eventide.operators import metrics as M
    from eventide.operators.factory import make_model
    from eventide.plans.q_models import cox_data
    from tests.conftest import SF_SMALL
    data, feats = cox_data(spark, SF_SMALL)
    est = make_model("cox_ph").fit(data, "t", "e", feats)
    grid = M.brier_grid(data, "t", "e", 20)
    got = M.brier_of(est, data, grid, "id")
    want = {r["time"]: r["brier"] for r in M.brier_long(est.predict_survival(data, grid, ["id"]), data, "id").collect()}
    assert len(want) == 20 and all(abs(r["brier"] - want[r["time"]]) < 1e-12 for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
