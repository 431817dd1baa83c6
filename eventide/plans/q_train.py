"""Registered queries: training orchestration and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import train as TR
from eventide.operators.concordance import concordance_by
from eventide.operators.factory import make_model
from eventide.plans import fixtures as fx
from eventide.plans.q_models import HZ, cox_data
from eventide.plans.registry import r6, register

R = fx.with_ctes(fx.REORDER_SQL)

# three single-marker "models" scored by concordance: order value, customer key, next-order status
_MARKERS_SQL = R.rstrip() + """,
m AS (SELECT 'price' AS model, price AS r, t, e FROM reorder
      UNION ALL SELECT 'cluster', CAST(cluster AS DOUBLE), t, e FROM reorder
      UNION ALL SELECT 'cause', CAST(cause AS DOUBLE), t, e FROM reorder),
pairs AS (SELECT a.model, a.r AS ra, b.r AS rb FROM m a JOIN m b ON a.model = b.model AND a.e = 1 AND b.t > a.t
          UNION ALL
          SELECT a.model, a.r, b.r FROM m a JOIN m b ON a.model = b.model AND a.e = 1 AND b.e = 0 AND b.t = a.t),
c AS (SELECT model, (count(*) FILTER (WHERE ra > rb) + 0.5 * count(*) FILTER (WHERE ra = rb)) / count(*)
        AS c_index FROM pairs GROUP BY model)
"""


def _marker_metrics(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    long = (df.select(F.lit("price").alias("model"), F.col("price").alias("risk"), "t", "e")
            .unionByName(df.select(F.lit("cluster").alias("model"), F.col("cluster").cast("double").alias("risk"),
                                   "t", "e"))
            .unionByName(df.select(F.lit("cause").alias("model"), F.col("cause").cast("double").alias("risk"),
                                   "t", "e")))
    return concordance_by(long, ["model"], "t", "e", "risk").select("model", "c_index")


@register("compare", _MARKERS_SQL + """
SELECT model, round(c_index, 6) AS c_index,
       CAST(rank() OVER (ORDER BY c_index DESC, model) AS INTEGER) AS c_index_rank FROM c""")
def compare_q(spark, sf_dir):
    out = TR.compare(_marker_metrics(spark, sf_dir))
    return out.select("model", r6(F.col("c_index")).alias("c_index"), F.col("c_index_rank").cast("int"))


@register("leaderboard", _MARKERS_SQL + "SELECT model, round(c_index, 6) AS c_index FROM c WHERE c_index IS NOT NULL")
def leaderboard_q(spark, sf_dir):
    out = TR.leaderboard(_marker_metrics(spark, sf_dir), "c_index")
    return out.select("model", r6(F.col("c_index")).alias("c_index"))


@register("cross_validate")
def cross_validate_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    return TR.cross_validate(data, "cox_ph", {}, "t", "e", feats, "id", k=5)


@register("fit_many")
def fit_many_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    cfgs = [{"name": "km", "kind": "kaplan_meier"}, {"name": "cox", "kind": "cox_ph"},
            {"name": "cox_ridge", "kind": "cox_ph", "penalizer": 0.1},
            {"name": "weibull", "kind": "weibull_aft"}, {"name": "loglogistic", "kind": "aft", "dist": "loglogistic"}]
    return TR.fit_many(data, cfgs, "t", "e", feats)


@register("tune")
def tune_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    space = {"penalizer": ("float", 1e-4, 1.0, "log"), "ties": ("categorical", ["efron", "breslow"])}
    return TR.tune(data, "cox_ph", space, "t", "e", feats, objective="c_index")


@register("train")
def train_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    out = TR.train(data, {"kind": "cox_ph", "params": {"penalizer": 0.01}}, "t", "e", feats)
    return out["metrics"]


@register("predict_batch")
def predict_batch_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    est = make_model("cox_ph").fit(data, "t", "e", feats)
    return TR.predict_batch(est, data, "id", HZ)


@register("permutation_importance")
def permutation_importance_q(spark, sf_dir):
    data, feats = cox_data(spark, sf_dir)
    est = make_model("weibull_aft").fit(data, "t", "e", feats)
    return TR.permutation_importance(est, data, feats, "id")
