"""Registered queries: boosted, neural and discrete-time models (rows-only checks)."""

from __future__ import annotations

from eventide.operators.boost import boost_fit
from eventide.operators.neural import deepsurv_fit, discrete_fit, neural_fit
from eventide.plans.q_models import HZ, cox_data
from eventide.plans.registry import register


@register("boost_fit")
def boost_fit_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = boost_fit(data, "t", "e", feats, "id", n_estimators=20, learning_rate=0.1, max_depth=3, subsample=0.8)
    return m.score(data, ["id"]).select("id", "f", "risk")


@register("split_importance")
def split_importance_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return boost_fit(data, "t", "e", feats, "id", n_estimators=10).importance(spark)


@register("boost_survival")
def boost_survival_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = boost_fit(data, "t", "e", feats, "id", n_estimators=10)
    return m.predict_survival(data, HZ, ["id"])


@register("deepsurv_fit")
def deepsurv_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = deepsurv_fit(data, "t", "e", feats, "id", hidden=(32, 16), epochs=20)
    return m.score(data, ["id"])


@register("deepsurv_survival")
def deepsurv_survival_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = deepsurv_fit(data, "t", "e", feats, "id", hidden=(32, 16), epochs=10)
    return m.predict_survival(data, HZ, ["id"])


@register("gradient_importance")
def gradient_importance_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return deepsurv_fit(data, "t", "e", feats, "id", hidden=(32, 16), epochs=10).gradient_importance(data)


@register("neural_resnet_cox")
def neural_resnet_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = neural_fit(data, "t", "e", feats, "id", loss="cox", hidden=(16, 16), arch="resnet", epochs=10)
    return m.score(data, ["id"])


@register("neural_parametric")
def neural_parametric_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = neural_fit(data, "t", "e", feats, "id", loss="parametric", hidden=(16,), epochs=20)
    return m.predict_survival(data, HZ, ["id"])


@register("neural_discrete")
def neural_discrete_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return discrete_fit(data, "t", "e", feats, time_buckets=10, hidden=(16,), max_iter=100).predict_risk(data, "id")


@register("bayes_fit")
def bayes_fit_q(spark, sf_dir):
    from eventide.operators.bayes import bayes_fit
    data, feats = cox_data(spark, sf_dir)
    return bayes_fit(data, "t", "e", feats, "id", "weibull").summary_table(spark)


@register("bayes_curve")
def bayes_curve_q(spark, sf_dir):
    from eventide.operators.bayes import bayes_fit
    data, feats = cox_data(spark, sf_dir)
    return bayes_fit(data, "t", "e", feats, "id", "lognormal",
                     with_waic=False).curve_bands(spark)


@register("bayes_predict")
def bayes_predict_q(spark, sf_dir):
    from eventide.operators.bayes import bayes_fit
    data, feats = cox_data(spark, sf_dir)
    m = bayes_fit(data, "t", "e", feats, "id", "exponential", with_waic=False)
    return m.predict_survival(data, HZ, ["id"])


@register("rsf_fit")
def rsf_fit_q(spark, sf_dir):
    from eventide.operators.forest import rsf_fit
    data, feats = cox_data(spark, sf_dir)
    m = rsf_fit(data, "t", "e", feats, "id", min_samples_leaf=5)
    return m.score(data, ["id"])


@register("rsf_importance")
def rsf_importance_q(spark, sf_dir):
    from eventide.operators.forest import rsf_fit
    data, feats = cox_data(spark, sf_dir)
    return rsf_fit(data, "t", "e", feats, "id", min_samples_leaf=5).importance(spark)


@register("rsf_survival")
def rsf_survival_q(spark, sf_dir):
    from eventide.operators.forest import rsf_fit
    data, feats = cox_data(spark, sf_dir)
    m = rsf_fit(data, "t", "e", feats, "id", min_samples_leaf=5)
    return m.predict_survival(data, HZ, ["id"])
