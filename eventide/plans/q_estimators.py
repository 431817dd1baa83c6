"""Registered queries: risk tables and non-parametric estimators (K-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import risk
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register
from eventide.plans.sqlgen import km_sql, risk_sql

R = fx.with_ctes(fx.REORDER_SQL)


def _curve_cols(strata):
    return [*strata, "time", "n_at_risk", "n_event", "n_censored",
            r6(F.col("survival")).alias("survival"), r6(F.col("ci_lower")).alias("ci_lower"),
            r6(F.col("ci_upper")).alias("ci_upper")]


KM_COLS_SQL = ("time, n_at_risk, n_event, n_censored, round(survival, 6) AS survival, "
               "round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper")


@register("km_by_segment", R.rstrip() + "," + km_sql("reorder", ["seg"]) +
          f"\nSELECT seg, {KM_COLS_SQL} FROM km")
def km_by_segment(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    return risk.kaplan_meier(df, "t", "e", "seg").select(*_curve_cols(["seg"]))


@register("km_overall", R.rstrip() + "," + km_sql("reorder", []) + f"\nSELECT {KM_COLS_SQL} FROM km")
def km_overall(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    return risk.kaplan_meier(df, "t", "e").select(*_curve_cols([]))


@register("risk_table", R.rstrip() + "," + risk_sql("reorder", ["prio"]) +
          "\nSELECT prio, time, n_at_risk, n_event, n_censored FROM r")
def risk_table_q(spark, sf_dir):
    return risk.risk_table(fx.reorder(spark, sf_dir), "t", "e", "prio")


@register("median_survival", R.rstrip() + "," + km_sql("reorder", ["seg"]) + """
SELECT seg, coalesce(min(CASE WHEN survival <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_time
FROM km GROUP BY seg""")
def median_survival_q(spark, sf_dir):
    curves = risk.kaplan_meier(fx.reorder(spark, sf_dir), "t", "e", "seg", with_ci=False)
    return risk.median_survival(curves, "seg")


@register("median_by_row", R.rstrip() + "," + km_sql("reorder", ["prio"]) + """,
m AS (SELECT prio, coalesce(min(CASE WHEN survival <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_time
      FROM km GROUP BY prio)
SELECT id, reorder.prio, median_time FROM reorder LEFT JOIN m ON reorder.prio = m.prio""")
def median_by_row_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    curves = risk.kaplan_meier(df, "t", "e", "prio", with_ci=False)
    overall = risk.kaplan_meier(df, "t", "e", with_ci=False)
    return risk.median_by_row(df.select("id", "prio"), curves, "prio", overall) \
        .select("id", "prio", "median_time")


@register("nelson_aalen", R.rstrip() + "," + risk_sql("reorder", ["seg"]) + """
SELECT seg, time, n_at_risk, n_event,
  round(sum(CAST(n_event AS DOUBLE) / n_at_risk) OVER w, 6) AS cumulative_hazard,
  round(sum(CAST(n_event AS DOUBLE) / n_at_risk / n_at_risk) OVER w, 6) AS variance
FROM r WINDOW w AS (PARTITION BY seg ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def nelson_aalen_q(spark, sf_dir):
    na = risk.nelson_aalen(fx.reorder(spark, sf_dir), "t", "e", "seg")
    return na.select("seg", "time", "n_at_risk", "n_event",
                     r6(F.col("cumulative_hazard")).alias("cumulative_hazard"),
                     r6(F.col("variance")).alias("variance"))


HORIZONS = [30.0, 90.0, 180.0, 365.0, 730.0, 5000.0]
_H_SQL = ", ".join(f"({h}::DOUBLE)" for h in HORIZONS)


@register("survival_at", R.rstrip() + "," + km_sql("reorder", ["seg"]) + f""",
h(time) AS (VALUES {_H_SQL}),
p AS (SELECT DISTINCT seg, h.time FROM km, h)
SELECT p.seg, p.time,
  round(arg_max(km.survival, km.time), 6) AS survival, round(arg_max(km.ci_lower, km.time), 6) AS ci_lower,
  round(arg_max(km.ci_upper, km.time), 6) AS ci_upper, arg_max(km.n_at_risk, km.time) AS n_at_risk
FROM p JOIN km ON km.seg = p.seg AND km.time <= p.time GROUP BY p.seg, p.time""")
def survival_at_q(spark, sf_dir):
    curves = risk.kaplan_meier(fx.reorder(spark, sf_dir), "t", "e", "seg")
    out = risk.survival_at(curves, HORIZONS, "seg")
    return out.select("seg", "time", r6(F.col("survival")).alias("survival"),
                      r6(F.col("ci_lower")).alias("ci_lower"), r6(F.col("ci_upper")).alias("ci_upper"),
                      "n_at_risk")


@register("km_ci", R.rstrip() + "," + km_sql("reorder", []) + """
SELECT time, round(survival, 6) AS survival, round(gw, 9) AS greenwood_variance,
       round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM km""")
def km_ci_q(spark, sf_dir):
    """K04 on its own: the Greenwood sum and the log-log interval of the overall curve."""
    df = fx.reorder(spark, sf_dir)
    curve = risk.kaplan_meier(df, "t", "e", with_ci=False, keep_greenwood=True)
    out = risk.add_loglog_ci(curve, "survival", "greenwood_variance")
    return out.select("time", r6(F.col("survival")).alias("survival"),
                      F.round("greenwood_variance", 9).alias("greenwood_variance"),
                      r6(F.col("ci_lower")).alias("ci_lower"), r6(F.col("ci_upper")).alias("ci_upper"))


FP = fx.with_ctes(fx.FIRST_PURCHASE_SQL)


@register("km_first_purchase", FP.rstrip() + "," + km_sql("first_purchase", []) + f"\nSELECT {KM_COLS_SQL} FROM km")
def km_first_purchase(spark, sf_dir):
    """Time from a user's first event to the first purchase, censored at 24 h (heavy censoring)."""
    return risk.kaplan_meier(fx.first_purchase(spark, sf_dir), "t", "e").select(*_curve_cols([]))
