"""Registered queries: remaining views, lookups, pipelines and model persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import clean as C
from eventide.operators import features as X
from eventide.operators import metrics as M
from eventide.operators import report as T
from eventide.operators import risk
from eventide.operators.cox import cox_fit
from eventide.operators.lookup import linear_lookup
from eventide.plans import fixtures as fx
from eventide.plans.q_metrics import G_SQL, HZ
from eventide.plans.q_models import cox_data
from eventide.plans.registry import r6, register
from eventide.plans.sqlgen import km_sql, risk_sql
from eventide.sources import io
from eventide.sources.models import load_cox, save_cox

R = fx.with_ctes(fx.REORDER_SQL)
D = fx.with_ctes(fx.DIRTY_SQL)


@register("cumulative_hazard_view", R.rstrip() + "," + risk_sql("reorder", ["prio"]) + """
SELECT prio, time, round(sum(CAST(n_event AS DOUBLE) / n_at_risk) OVER (PARTITION BY prio ORDER BY time
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative_hazard FROM r""")
def cumulative_hazard_view_q(spark, sf_dir):
    na = risk.nelson_aalen(fx.reorder(spark, sf_dir), "t", "e", "prio")
    return na.select("prio", "time", r6(F.col("cumulative_hazard")).alias("cumulative_hazard"))


@register("time_dependent_view", R.rstrip() + "," + km_sql("reorder", ["seg"]) + G_SQL + """,
sp AS (SELECT km.seg, h.time AS h, arg_max(km.survival, km.time) AS s FROM h JOIN km ON km.time <= h.time
       GROUP BY km.seg, h.time),
b AS (SELECT gh.h AS time, avg(CASE WHEN x.t <= gh.h AND x.e = 1 THEN coalesce(sp.s * sp.s / nullif(x.gt, 0), 0)
                              WHEN x.t > gh.h THEN CASE WHEN gh.gh > 0 THEN (1 - sp.s) * (1 - sp.s) / gh.gh
                                                        ELSE 0 END ELSE 0 END) AS brier
      FROM x JOIN sp ON sp.seg = x.seg JOIN gh ON gh.h = sp.h GROUP BY gh.h),
xs AS (SELECT h.time AS h, x.price AS r,
              CASE WHEN x.t <= h.time AND x.e = 1 THEN coalesce(1.0 / nullif(x.gt, 0), 0) ELSE 0 END AS wc,
              CASE WHEN x.t > h.time THEN 1.0 ELSE 0 END AS nc FROM x, h),
gr AS (SELECT h, r, sum(wc) AS wc, sum(nc) AS nc FROM xs GROUP BY h, r),
cu AS (SELECT *, sum(nc) OVER (PARTITION BY h ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS nc_le FROM gr),
a AS (SELECT h AS time, sum(wc * (nc_le - nc + 0.5 * nc)) / (sum(wc) * sum(nc)) AS auc FROM cu GROUP BY h)
SELECT b.time, round(b.brier, 6) AS brier, round(a.auc, 6) AS auc FROM b JOIN a ON a.time = b.time""")
def time_dependent_view_q(spark, sf_dir):
    df = fx.reused(fx.reorder(spark, sf_dir), "seg", "t", "e", "price")
    curves = risk.kaplan_meier(df, "t", "e", "seg", with_ci=False)
    pred = risk.km_predictions(df, curves, "seg", HZ)
    G = M.censoring_km(df, "t", "e")
    b = M.brier_scores(pred, HZ, [f"S_{k}" for k in range(len(HZ))], "t", "e", G)
    a = M.dynamic_auc(df.withColumn("risk", F.col("price")), HZ, "risk", "t", "e", G)
    v = T.time_dependent_view(b, a)
    return v.select("time", r6(F.col("brier")).alias("brier"), r6(F.col("auc")).alias("auc"))


@register("linear_lookup", R.rstrip() + "," + km_sql("reorder", []) + """,
p AS (SELECT id, CAST(t AS DOUBLE) + 0.5 AS time FROM reorder),
lo AS (SELECT p.id, p.time, arg_max(km.survival, km.time) AS sv, max(km.time) AS tv
       FROM p JOIN km ON km.time <= p.time GROUP BY p.id, p.time),
hi AS (SELECT p.id, arg_min(km.survival, km.time) AS sn, min(km.time) AS tn
       FROM p JOIN km ON km.time >= p.time GROUP BY p.id)
SELECT lo.id, lo.time, round(CASE WHEN hi.tn IS NULL OR hi.tn = lo.tv THEN lo.sv
                                  ELSE lo.sv + (lo.time - lo.tv) / (hi.tn - lo.tv) * (hi.sn - lo.sv) END, 6)
                        AS survival
FROM lo LEFT JOIN hi ON hi.id = lo.id""")
def linear_lookup_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    curve = risk.kaplan_meier(df, "t", "e", with_ci=False).select("time", "survival")
    pts = df.select("id", (F.col("t") + 0.5).alias("time"))
    out = linear_lookup(curve, pts, [], "time", "survival", "id")
    return out.select("id", "time", r6(F.col("survival")).alias("survival"))


@register("fit_apply_cleaner", D + """
SELECT id, round(coalesce(price, (SELECT median(price) FROM dirty)), 6) AS price,
       coalesce(prio, (SELECT prio FROM dirty WHERE prio IS NOT NULL GROUP BY prio
                       ORDER BY count(*) DESC, prio LIMIT 1)) AS prio FROM dirty""")
def fit_apply_cleaner_q(spark, sf_dir):
    d = fx.dirty(spark, sf_dir)
    fitted = C.fit_cleaner(d, ["price", "prio"])
    out = C.apply_fill(d.select("id", "price", "prio"), fitted)
    return out.select("id", r6(F.col("price")).alias("price"), "prio")


def _encoder_sql():
    levels = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # first level (1-URGENT) dropped
    cols = ", ".join(f"CASE WHEN prio = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"prio_{v}\"" for v in levels)
    return R + f"SELECT id, {cols} FROM reorder"


@register("fit_apply_encoder", _encoder_sql())
def fit_apply_encoder_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "prio")
    enc = C.fit_encoder(df, ["prio"])
    return C.apply_encoder(df, enc)


@register("clean", D + """,
med AS (SELECT avg(price) AS mp FROM dirty),
f AS (SELECT id, coalesce(price, mp) AS price, t, coalesce(prio, '') AS prio, cause FROM dirty, med),
z AS (SELECT avg(price) AS m1, stddev_samp(price) AS s1, avg(CAST(cause AS DOUBLE)) AS m2,
             stddev_samp(CAST(cause AS DOUBLE)) AS s2 FROM f)
SELECT id, round((price - m1) / s1, 6) AS price, t, prio, round((cause - m2) / s2, 6) AS cause FROM f, z""".replace(
    D + ",", D.rstrip() + ","))
def clean_q(spark, sf_dir):
    d = fx.dirty(spark, sf_dir).select("id", "price", "t", "prio", "cause")
    out = C.clean(d, {"impute_numeric": "mean", "impute_categorical": "empty_string", "normalize": "z_score",
                      "keep": ["id"]}, time="t")
    return out.select("id", r6(F.col("price")).alias("price"), "t", "prio", r6(F.col("cause")).alias("cause"))


@register("engineer", R + """
SELECT id, round(cause + price, 6) AS ft_cause_plus_price, round(cause * price, 6) AS ft_cause_times_price,
       round(cause / price, 6) AS ft_cause_div_price,
       round(price * CAST(cause AS DOUBLE), 6) AS interaction_price_x_cause,
       round(price * price, 2) AS price_squared, round(CAST(cause * cause AS DOUBLE), 2) AS cause_squared
FROM reorder""")
def engineer_q(spark, sf_dir):
    d = fx.reorder(spark, sf_dir).select("id", "price", "cause")
    out = X.engineer(d, {"pairwise": True, "interactions": True, "polynomial": True}, exclude=["id"])
    cols = [c for c in out.columns if c.startswith(("ft_", "interaction_"))]
    sq = [c for c in out.columns if c.endswith("_squared")]
    return out.select("id", *[r6(F.col(c)).alias(c) for c in cols], *[F.round(F.col(c), 2).alias(c) for c in sq])


@register("prepare", D + """,
v AS (SELECT median(price) AS mp,
             (SELECT prio FROM dirty WHERE prio IS NOT NULL GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1) AS mo
      FROM dirty),
f AS (SELECT id, coalesce(price, mp) AS price, coalesce(prio, mo) AS prio, t,
             CASE lower(trim(status)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS status FROM dirty, v)
SELECT id, round(price, 6) AS price,
       CASE WHEN prio = '2-HIGH' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "prio_2-HIGH",
       CASE WHEN prio = '3-MEDIUM' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "prio_3-MEDIUM",
       CASE WHEN prio = '4-NOT SPECIFIED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "prio_4-NOT SPECIFIED",
       CASE WHEN prio = '5-LOW' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "prio_5-LOW", t, status FROM f""".replace(
    D + ",", D.rstrip() + ","))
def prepare_q(spark, sf_dir):
    d = fx.dirty(spark, sf_dir)
    out, state = C.prepare(d, "t", "status", ["price", "prio"], keep=["id"])
    feats = state["features"]
    return out.select("id", *[r6(F.col(f)).alias(f) if f == "price" else F.col(f) for f in feats], "t", "status")


@register("model_roundtrip")
def model_roundtrip_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = cox_fit(data, "t", "e", feats, with_concordance=False)
    path = io.scratch_path(spark, "model")
    save_cox(m, path, spark)
    m2 = load_cox(path, spark)
    a = m.predict_risk(data).select("id", F.col("risk").alias("risk_fit"))
    b = m2.predict_risk(data).select("id", F.col("risk").alias("risk_loaded"))
    return a.join(b, "id")


@register("export_report", R + "SELECT seg, count(*) AS n FROM reorder GROUP BY seg")
def export_report_q(spark, sf_dir):
    root = io.scratch_path(spark, "report")
    tbl = fx.reorder(spark, sf_dir).groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    out = io.export_report({"by_segment": tbl}, root, "json")
    return io.read_json(spark, out["by_segment"], "seg string, n long", lines=True)


@register("expected_observed")
def expected_observed_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    m = cox_fit(data, "t", "e", feats, with_concordance=False)
    pred = m.predict_risk(data)
    h = m.baseline_at(HZ)
    for k, hk in enumerate(h):
        pred = pred.withColumn(f"S_{k}", F.exp(-F.lit(hk) * F.col("risk")))
    km = risk.kaplan_meier(data, "t", "e", with_ci=False)
    s = {r["time"]: r["survival"] for r in risk.survival_at(km, HZ, cols=["survival"]).collect()}
    return M.expected_observed(pred, s, [f"S_{k}" for k in range(len(HZ))], HZ)


@register("trend_factors")
def trend_factors_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return T.trend_factors(cox_fit(data, "t", "e", feats, with_concordance=False).coefficients(spark))


@register("hazard_ratio_view")
def hazard_ratio_view_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    c = cox_fit(data, "t", "e", feats, with_concordance=False).coefficients(spark)
    return T.hazard_ratio_view(c, "abs_value", 5)


@register("feature_importance_view")
def feature_importance_view_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return T.feature_importance_view(cox_fit(data, "t", "e", feats, with_concordance=False).importance(spark), 5)
