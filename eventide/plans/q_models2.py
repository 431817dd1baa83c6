"""Registered queries: AFT, frailty, additive, robust variance, calibration, competing summary."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import competing as CR
from eventide.operators.additive import aalen_additive_fit, additive_risk
from eventide.operators.aft import aft_fit
from eventide.operators.cox import calibration_slope, cox_fit, robust_variance
from eventide.operators.frailty import frailty_fit
from eventide.operators.split import random_split
from eventide.plans.q_models import HZ, cox_data
from eventide.plans.registry import register


@register("aft_fit")
def aft_fit_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    out = None
    for d in ("weibull", "lognormal", "loglogistic"):
        c = aft_fit(data, "t", "e", feats, d, with_concordance=False).coefficients(spark) \
            .withColumn("dist", F.lit(d))
        out = c if out is None else out.unionByName(c)
    return out


@register("aft_predict")
def aft_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = aft_fit(data, "t", "e", feats, "lognormal", with_concordance=False)
    return m.predict_survival(data, HZ, ["id"]).join(m.predict(data).select("id", "median_time", "risk"), "id")


@register("aft_importance")
def aft_importance_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return aft_fit(data, "t", "e", feats, "weibull", with_concordance=False).importance(spark)


@register("frailty_fit")
def frailty_fit_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = frailty_fit(data, "t", "e", feats, cluster="cluster", max_em=10)
    return m.coefficients(spark).withColumn("theta", F.lit(m.theta))


@register("frailty_predict")
def frailty_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = frailty_fit(data, "t", "e", feats, cluster="cluster")
    return m.predict_risk(data).select("id", "cluster", "risk")


@register("aalen_additive_fit")
def additive_fit_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return aalen_additive_fit(data, "t", "e", feats, 0.5).cumulative_coef


@register("aalen_additive_predict")
def additive_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = aalen_additive_fit(data, "t", "e", feats, 0.5)
    return m.predict_cumulative_hazard(data, HZ, ["id"]).join(additive_risk(m, data, ["id"]), "id")


@register("cox_robust")
def cox_robust_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = cox_fit(data, "t", "e", feats, ties="breslow", with_concordance=False)
    v = robust_variance(m, data, "t", "e", cluster="cluster")
    rows = [(f, float(m.coef[j]), float(m.se[j]), float(np.sqrt(v[j, j]))) for j, f in enumerate(feats)]
    return spark.createDataFrame(rows, "feature string, coef double, se double, robust_se double")


@register("calibration_slope")
def calibration_slope_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    train, test = random_split(data, "id", 0.3, 42)
    m = cox_fit(train, "t", "e", feats, with_concordance=False)
    s = calibration_slope(m, test, "t", "e")
    return test.agg(F.count(F.lit(1)).alias("n_test")).select("n_test", F.lit(s).alias("calibration_slope"))


@register("competing_summary")
def competing_summary_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    models = CR.cause_specific_fit(data, "t", "cause", feats)
    cif = CR.cause_specific_cif(models, data, [30.0 * k for k in range(1, 25)], "id")
    return CR.competing_summary(cif, "id")
