"""Registered queries: regression and machine-learned survival models (M-rows).

Model outputs are checked against closed forms / direct formulas in the
tests (golden), so most entries here carry no SQL oracle (rows-only check).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from eventide.operators import clean as C
from eventide.operators import competing as CR
from eventide.operators.cox import cox_fit
from eventide.operators.multistate import multi_state_fit
from eventide.plans import fixtures as fx
from eventide.plans.registry import register
from eventide.plans.scan import right_size

COVARIATES = ["price", "prio", "seg"]
HZ = [90.0, 180.0, 365.0]


def cox_data(spark, sf_dir):
    """Reorder fixture prepared for modelling: price (scaled to thousands) + one-hot prio, seg."""
    # the fixture feeds several fitting aggregates: compute it once
    df = right_size(fx.reorder(spark, sf_dir).withColumn("price", F.col("price") / 1000.0)) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    data, state = C.prepare(df, "t", "e", COVARIATES, keep=["id", "cause", "cluster"])
    return data, state["features"]


@register("cox_fit")
def cox_fit_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return cox_fit(data, "t", "e", feats, with_concordance=False).coefficients(spark)


@register("cox_summary")
def cox_summary_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    s = cox_fit(data, "t", "e", feats).summary()
    return spark.createDataFrame([(s["n"], s["events"], s["log_likelihood"], s["aic_partial"],
                                   s["lr_statistic"], s["lr_p_value"], s["concordance"])],
                                 "n long, events double, log_likelihood double, aic_partial double, "
                                 "lr_statistic double, lr_p_value double, concordance double")


@register("cox_predict")
def cox_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = cox_fit(data, "t", "e", feats, with_concordance=False)
    risk = m.predict_risk(data).select("id", "risk")
    med = m.predict_median(data, "id")
    return risk.join(med, "id")


@register("cox_survival")
def cox_survival_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = cox_fit(data, "t", "e", feats, with_concordance=False)
    return m.predict_survival(data, HZ, keep=["id"])


@register("cox_importance")
def cox_importance_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return cox_fit(data, "t", "e", feats, with_concordance=False).importance(spark)


@register("cox_elastic_net")
def cox_elastic_net_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return cox_fit(data, "t", "e", feats, penalizer=0.01, l1_ratio=0.5, with_concordance=False) \
        .coefficients(spark)


@register("cause_specific_fit")
def cause_specific_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return CR.competing_importance(CR.cause_specific_fit(data, "t", "cause", feats), spark)


@register("fine_gray_fit")
def fine_gray_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return CR.fine_gray_fit(data, "t", "cause", feats, 1).coefficients(spark)


@register("cif_predict")
def cif_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return CR.fine_gray_fit(data, "t", "cause", feats, 1).predict_cif(data, HZ, keep=["id"])


@register("competing_predict")
def competing_predict_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    models = CR.cause_specific_fit(data, "t", "cause", feats)
    return CR.competing_predict(models, data, HZ, "id")


def _journey(spark, sf_dir):
    return fx.journey(spark, sf_dir)


@register("multi_state_fit")
def multi_state_fit_q(spark, sf_dir):
    return multi_state_fit(_journey(spark, sf_dir), ["value"]).coefficients(spark)


@register("multi_state_predict")
def multi_state_predict_q(spark, sf_dir):
    df = _journey(spark, sf_dir)
    return multi_state_fit(df, ["value"]).predict(df, "id")


@register("multi_state_summary")
def multi_state_summary_q(spark, sf_dir):
    df = _journey(spark, sf_dir)
    s = multi_state_fit(df, ["value"]).summary(df)
    return spark.createDataFrame([(s["states"], s["transitions"], s["n"], s["events"], s["log_likelihood"],
                                   s["aic"], s["c_index"])], "states int, transitions int, n long, events double, "
                                                             "log_likelihood double, aic double, c_index double")


@register("multi_state_survival")
def multi_state_survival_q(spark, sf_dir):
    df = _journey(spark, sf_dir)
    return multi_state_fit(df, ["value"]).predict_survival(df, "id", [1.0, 6.0, 24.0])
