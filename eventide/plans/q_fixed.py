"""Registered queries: model formulas at fixed coefficients, which SQL can state without a fit.

Likelihoods, scores and information of the Cox (Breslow and Efron) and accelerated failure time
models, and everything a fitted Cox model derives from its coefficients: baseline hazard, risks,
medians, survival, coefficient tables and views.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import metrics as M
from eventide.operators import report as T
from eventide.operators import risk
from eventide.operators.aft import _stats
from eventide.operators.cox import cox_fit, cox_partial_loglik
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register
from eventide.plans.sqlgen import km_sql
from eventide.sources import io, models

B1, B2 = 0.05, -0.2
FEATURES = ["x1", "x2"]
HZ = [90.0, 180.0, 365.0]

# rows with two covariates, their partial hazard w (at raw and at centred covariates)
X = fx.with_ctes(fx.REORDER_SQL).rstrip() + f""",
x0 AS (SELECT id, t, e, price / 1000.0 AS x1, CASE WHEN seg = 'BUILDING' THEN 1.0 ELSE 0.0 END AS x2 FROM reorder),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2 FROM x0),
x AS (SELECT x0.*, {B1} * x1 + {B2} * x2 AS lp, exp({B1} * x1 + {B2} * x2) AS w,
             exp({B1} * (x1 - m1) + {B2} * (x2 - m2)) AS risk FROM x0, m)"""
# risk-set sums s*, sums over the tied events k*
TIMES = X + """,
g AS (SELECT t, sum(e) AS d, sum(e * lp) AS el, sum(e * x1) AS e1, sum(e * x2) AS e2,
             sum(w) AS w, sum(w * x1) AS w1, sum(w * x2) AS w2, sum(w * x1 * x1) AS w11, sum(w * x1 * x2) AS w12, sum(w * x2 * x2) AS w22,
             sum(e * w) AS k, sum(e * w * x1) AS k1, sum(e * w * x2) AS k2, sum(e * w * x1 * x1) AS k11, sum(e * w * x1 * x2) AS k12,
             sum(e * w * x2 * x2) AS k22 FROM x GROUP BY t),
r AS (SELECT *, sum(w) OVER v AS s, sum(w1) OVER v AS s1, sum(w2) OVER v AS s2, sum(w11) OVER v AS s11, sum(w12) OVER v AS s12, sum(w22) OVER v AS s22
      FROM g WINDOW v AS (ORDER BY t DESC))"""


def _loglik_sql(efron: bool) -> str:
    """One row per tied event (Efron) or per event with the whole risk set (Breslow)."""
    f = "CAST(l.l AS DOUBLE) / d" if efron else "0.0"
    terms = ", ".join(f"s{c} - {f} * k{c} AS z{c}" for c in ("", "1", "2", "11", "12", "22"))
    return TIMES + f""",
z AS (SELECT {terms} FROM r, unnest(range(CAST(d AS BIGINT))) AS l(l) WHERE d > 0),
zs AS (SELECT sum(ln(z)) AS lz, sum(z1 / z) AS a1, sum(z2 / z) AS a2, sum(z11 / z - z1 * z1 / z / z) AS i11,
              sum(z12 / z - z1 * z2 / z / z) AS i12, sum(z22 / z - z2 * z2 / z / z) AS i22 FROM z),
es AS (SELECT sum(el) AS el, sum(e1) AS e1, sum(e2) AS e2 FROM g),
fit AS (SELECT el - lz AS loglik, e1 - a1 AS score_1, e2 - a2 AS score_2, i11 AS info_11, i12 AS info_12, i22 AS info_22 FROM zs, es)"""


_OUT = "SELECT " + ", ".join(f"round({c}, 4) AS {c}" for c in ("loglik", "score_1", "score_2", "info_11", "info_12", "info_22")) + " FROM fit"


def rows(spark, sf_dir):
    return fx.reorder(spark, sf_dir).select("id", "t", "e", (F.col("price") / 1000.0).alias("x1"),
                                            F.when(F.col("seg") == "BUILDING", 1.0).otherwise(0.0).alias("x2"))


def fixed(spark, sf_dir, ties="efron"):
    data = fx.reused(rows(spark, sf_dir), "id", "t", "e", *FEATURES)
    return data, cox_fit(data, "t", "e", FEATURES, ties=ties, max_iter=0, init=[B1, B2], with_concordance=False)


def _loglik(spark, sf_dir, ties):
    ll, g, info = cox_partial_loglik(rows(spark, sf_dir), "t", "e", FEATURES, [B1, B2], ties)
    values = [ll, g[0], g[1], info[0][0], info[0][1], info[1][1]]
    names = ("loglik", "score_1", "score_2", "info_11", "info_12", "info_22")
    return spark.range(1).select(*[F.round(F.lit(float(v)), 4).alias(n) for v, n in zip(values, names, strict=True)])


@register("cox_loglik_breslow", _loglik_sql(False) + _OUT)
def cox_loglik_breslow_q(spark, sf_dir):
    return _loglik(spark, sf_dir, "breslow")


@register("cox_loglik_efron", _loglik_sql(True) + _OUT)
def cox_loglik_efron_q(spark, sf_dir):
    return _loglik(spark, sf_dir, "efron")


BASE = X + """,
b0 AS (SELECT t, sum(e) AS d, sum(risk) AS r FROM x GROUP BY t),
b1 AS (SELECT t, d / sum(r) OVER (ORDER BY t DESC) AS dh FROM b0),
base AS (SELECT t AS time, sum(dh) OVER (ORDER BY t) AS h0 FROM b1)"""


@register("cox_baseline_fixed", BASE + "SELECT time, round(h0, 6) AS baseline_hazard, round(exp(-h0), 6) AS baseline_survival FROM base")
def cox_baseline_fixed_q(spark, sf_dir):
    _, m = fixed(spark, sf_dir)
    return m.baseline.select("time", r6(F.col("baseline_hazard")).alias("baseline_hazard"), r6(F.col("baseline_survival")).alias("baseline_survival"))


_AT = BASE + f""",
hz(time) AS (VALUES {', '.join(f'({h}::DOUBLE)' for h in HZ)}),
hat AS (SELECT hz.time, coalesce(max(h0), 0) AS h0 FROM hz LEFT JOIN base ON base.time <= hz.time GROUP BY hz.time)"""


@register("cox_survival_fixed", _AT + "SELECT id, hat.time, round(risk, 6) AS risk, round(exp(-h0 * risk), 6) AS survival FROM x, hat")
def cox_survival_fixed_q(spark, sf_dir):
    data, m = fixed(spark, sf_dir)
    s = m.predict_survival(data, HZ, ["id"])
    return s.join(m.predict_risk(data).select("id", r6(F.col("risk")).alias("risk")), "id") \
        .select("id", "time", "risk", r6(F.col("survival")).alias("survival"))


@register("cox_median_fixed", BASE + f"""
SELECT id, coalesce(min(base.time), 'inf'::DOUBLE) AS median_time
FROM x LEFT JOIN base ON base.h0 * x.risk >= {math.log(2.0)!r} GROUP BY id""")
def cox_median_fixed_q(spark, sf_dir):
    data, m = fixed(spark, sf_dir)
    return m.predict_median(data, "id")


_COEF = _loglik_sql(True) + f""",
se AS (SELECT sqrt(info_22 / (info_11 * info_22 - info_12 * info_12)) AS se1, sqrt(info_11 / (info_11 * info_22 - info_12 * info_12)) AS se2 FROM fit),
coefs AS (SELECT 'x1' AS feature, {B1}::DOUBLE AS coef, se1 AS se FROM se UNION ALL SELECT 'x2', {B2}::DOUBLE, se2 FROM se),
c AS (SELECT feature, coef, se, coef / se AS z, exp(coef) AS hazard_ratio, exp(coef - 1.959963984540054 * se) AS hr_lower,
             exp(coef + 1.959963984540054 * se) AS hr_upper FROM coefs)"""


def _rounded(df, *cols):
    return df.select("feature", *[r6(F.col(c)).alias(c) for c in cols])


@register("cox_coefficients_fixed", _COEF + "SELECT feature, round(coef, 6) AS coef, round(se, 6) AS se, round(z, 4) AS z, "
                                            "round(hazard_ratio, 6) AS hazard_ratio, round(hr_lower, 6) AS hr_lower, round(hr_upper, 6) AS hr_upper FROM c")
def cox_coefficients_fixed_q(spark, sf_dir):
    _, m = fixed(spark, sf_dir)
    return _rounded(m.coefficients(spark), "coef", "se", "z", "hazard_ratio", "hr_lower", "hr_upper").withColumn("z", F.round("z", 4))


@register("hazard_ratio_view_fixed", _COEF + "SELECT feature, round(coef, 6) AS coef, round(hazard_ratio, 6) AS hazard_ratio, "
                                             "round(hr_lower, 6) AS hr_lower, round(hr_upper, 6) AS hr_upper FROM c ORDER BY abs(coef) DESC LIMIT 1")
def hazard_ratio_view_fixed_q(spark, sf_dir):
    _, m = fixed(spark, sf_dir)
    return _rounded(T.hazard_ratio_view(m.coefficients(spark), "abs_value", 1), "coef", "hazard_ratio", "hr_lower", "hr_upper")


@register("feature_importance_fixed", "SELECT * FROM (VALUES ('x2', 0.2::DOUBLE), ('x1', 0.05::DOUBLE)) v(feature, importance)")
def feature_importance_fixed_q(spark, sf_dir):
    _, m = fixed(spark, sf_dir)
    return _rounded(T.feature_importance_view(m.importance(spark), 5), "importance")


@register("trend_factors_fixed", _COEF + """SELECT feature AS name, CASE WHEN coef > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction,
round(abs(coef), 6) AS magnitude FROM c""")
def trend_factors_fixed_q(spark, sf_dir):
    _, m = fixed(spark, sf_dir)
    return T.trend_factors(m.coefficients(spark)).select("name", "direction", r6(F.col("magnitude")).alias("magnitude"))


@register("expected_observed_fixed", _AT.rstrip() + "," + km_sql("x", []) + f""",
ob AS (SELECT hz.time, 1 - coalesce(min(km.survival), 1) AS observed FROM hz LEFT JOIN km ON km.time <= hz.time GROUP BY hz.time),
ex AS (SELECT hat.time, avg(1 - exp(-h0 * risk)) AS expected FROM x, hat GROUP BY hat.time)
SELECT time, round(expected, 6) AS expected, round(observed, 6) AS observed, round(expected / observed, 6) AS ratio FROM ex JOIN ob USING (time)""")
def expected_observed_fixed_q(spark, sf_dir):
    data, m = fixed(spark, sf_dir)
    pred = m.predict_risk(data)
    for k, h in enumerate(m.baseline_at(HZ)):
        pred = pred.withColumn(f"S_{k}", F.exp(-F.lit(h) * F.col("risk")))
    km = risk.kaplan_meier(data, "t", "e", with_ci=False)
    s = {r["time"]: r["survival"] for r in risk.survival_at(km, HZ, cols=["survival"]).collect()}
    out = M.expected_observed(pred, s, [f"S_{k}" for k in range(len(HZ))], HZ)
    return out.select("time", *[r6(F.col(c)).alias(c) for c in ("expected", "observed", "ratio")])


@register("model_roundtrip_fixed", X + f"SELECT id, round(risk, 6) AS risk_loaded FROM x")  # noqa: F541
def model_roundtrip_fixed_q(spark, sf_dir):
    data, m = fixed(spark, sf_dir)
    path = io.scratch_path(spark, "model-fixed")
    models.save_model(m, path, spark)
    return models.load_model(path, spark).predict_risk(data).select("id", r6(F.col("risk")).alias("risk_loaded"))


# accelerated failure time at theta = (intercept, b1, b2, log sigma)
THETA = [5.0, 0.001, 0.1, 0.3]
_Z = X + f""",
a AS (SELECT *, ln(t) AS lt, (ln(t) - {THETA[0]} - {THETA[1]} * x1 - {THETA[2]} * x2) / exp({THETA[3]}) AS z FROM x),"""
_AFT = {
    "weibull": "ll AS (SELECT e, x1, x2, z, e * (z - exp(z)) - (1 - e) * exp(z) - e * (lt + 0.3) AS ll, e - exp(z) AS h FROM a)",
    "loglogistic": "ll AS (SELECT e, x1, x2, z, e * (z - 2 * ln(1 + exp(z))) - (1 - e) * ln(1 + exp(z)) - e * (lt + 0.3) AS ll, "
                   "e - (1 + e) * exp(z) / (1 + exp(z)) AS h FROM a)",
}


def _aft(dist):
    sql = _Z + _AFT[dist] + f"""
SELECT round(sum(ll), 4) AS loglik, round(sum(-h / exp({THETA[3]})), 4) AS score_0, round(sum(-h * x1 / exp({THETA[3]})), 3) AS score_1,
       round(sum(-h * x2 / exp({THETA[3]})), 4) AS score_2, round(sum(-e - z * h), 4) AS score_scale FROM ll"""

    @register(f"aft_loglik_{dist}", sql)
    def query(spark, sf_dir):
        x = rows(spark, sf_dir).select("t", "e", F.col("x1").alias("x0"), F.col("x2").alias("x1"))
        ll, g, _ = _stats(x, np.array(THETA), 2, dist)
        digits = {"loglik": 4, "score_0": 4, "score_1": 3, "score_2": 4, "score_scale": 4}
        return spark.range(1).select(*[F.round(F.lit(float(v)), d).alias(n) for (n, d), v in zip(digits.items(), [ll, *g], strict=True)])
    return query


for _dist in _AFT:
    _aft(_dist)
