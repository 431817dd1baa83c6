"""Registered queries: report and chart tables (T-rows), transition counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import logrank as LR
from eventide.operators import report as T
from eventide.operators import risk
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register
from eventide.plans.sqlgen import km_sql
from eventide.sources.tables import table

R = fx.with_ctes(fx.REORDER_SQL)
J = fx.with_ctes(fx.JOURNEY_SQL)
HZ = [90.0, 180.0, 365.0]
_HV = ", ".join(f"({h}::DOUBLE)" for h in HZ)

# risk groups on the order value score, quantile thresholds 25 % / 75 %
RG_SQL = R.rstrip() + """,
q AS (SELECT quantile_cont(price, 0.25) AS lo, quantile_cont(price, 0.75) AS hi FROM reorder),
rg AS (SELECT reorder.*, CASE WHEN price <= lo THEN 'low' WHEN price >= hi THEN 'high' ELSE 'medium' END
          AS risk_group, lo, hi FROM reorder, q)"""


def _rg(spark, sf_dir):
    df = fx.reused(fx.reorder(spark, sf_dir), "id", "price", "t", "e")
    lo, hi = T.risk_thresholds(df, "price", (0.25, 0.75), "quantile")
    return T.assign_risk_group(df, "price", lo, hi)


@register("risk_groups", RG_SQL + """
SELECT risk_group, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM rg), 6) AS percent,
       round(any_value(lo), 6) AS low_threshold, round(any_value(hi), 6) AS high_threshold
FROM rg GROUP BY risk_group""")
def risk_groups_q(spark, sf_dir):
    g = T.risk_groups(fx.reorder(spark, sf_dir), "price", (0.25, 0.75), "quantile")
    return g.select("risk_group", "count", *[r6(F.col(c)).alias(c) for c in
                                             ("percent", "low_threshold", "high_threshold")])


@register("risk_group_table", RG_SQL.rstrip() + "," + km_sql("rg", ["risk_group"]) + """,
med AS (SELECT risk_group, coalesce(min(CASE WHEN survival <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_time
        FROM km GROUP BY risk_group)
SELECT rg.risk_group, count(*) AS n, CAST(sum(e) AS BIGINT) AS events,
       round(count(*) / (SELECT count(*) FROM rg), 6) AS proportion, any_value(median_time) AS median_time
FROM rg JOIN med ON med.risk_group = rg.risk_group GROUP BY rg.risk_group""")
def risk_group_table_q(spark, sf_dir):
    t = T.risk_group_table(_rg(spark, sf_dir), "risk_group")
    return t.select("risk_group", "n", "events", r6(F.col("proportion")).alias("proportion"), "median_time")


@register("risk_group_hr")
def risk_group_hr_q(spark, sf_dir):
    return T.group_hazard_ratios(_rg(spark, sf_dir), "risk_group", "low", levels=["medium", "high"])


# three groups: the statistic from the 2 x 2 covariance in closed form, and the chi-square tail at 2 df
@register("risk_group_logrank", RG_SQL.rstrip() + """,
tt AS (SELECT t, count(*) AS n, sum(e) AS d, count(*) FILTER (risk_group = 'high') AS n1, count(*) FILTER (risk_group = 'low') AS n2,
              coalesce(sum(e) FILTER (risk_group = 'high'), 0) AS d1, coalesce(sum(e) FILTER (risk_group = 'low'), 0) AS d2 FROM rg GROUP BY t),
rs AS (SELECT d, d1, d2, sum(n) OVER w AS n, sum(n1) OVER w AS n1, sum(n2) OVER w AS n2 FROM tt WINDOW w AS (ORDER BY t DESC)),
v AS (SELECT d1 - d * n1 / n AS u1, d2 - d * n2 / n AS u2, CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END AS f, n1 / n AS p1, n2 / n AS p2 FROM rs),
s AS (SELECT sum(u1) AS u1, sum(u2) AS u2, sum(f * p1 * (1 - p1)) AS v11, sum(f * p2 * (1 - p2)) AS v22, -sum(f * p1 * p2) AS v12 FROM v),
q2 AS (SELECT (u1 * u1 * v22 - 2 * u1 * u2 * v12 + u2 * u2 * v11) / (v11 * v22 - v12 * v12) AS statistic FROM s)
SELECT (SELECT count(*) FROM rg) AS n, round(statistic, 4) AS statistic, 2 AS df, round(exp(-statistic / 2), 6) AS p_value FROM q2""")
def risk_group_logrank_q(spark, sf_dir):
    df = _rg(spark, sf_dir)
    r = LR.logrank(df, "risk_group")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.round(F.lit(r["statistic"]), 4).alias("statistic"), F.lit(r["df"]).alias("df"),
        F.round(F.lit(r["p_value"]), 6).alias("p_value"))


@register("risk_group_profile", RG_SQL + """
SELECT risk_group, count(*) AS n, round(avg(price), 6) AS price_mean, round(median(price), 6) AS price_median,
       round(avg(t), 6) AS t_mean, round(median(t), 6) AS t_median FROM rg GROUP BY risk_group""")
def risk_group_profile_q(spark, sf_dir):
    p = T.group_profile(_rg(spark, sf_dir), "risk_group", ["price", "t"])
    return p.select("risk_group", "n", *[r6(F.col(c)).alias(c) for c in
                                         ("price_mean", "price_median", "t_mean", "t_median")])


_SAT_COLS = ("round(arg_max(km.survival, km.time), 6) AS survival, round(arg_max(km.ci_lower, km.time), 6) "
             "AS ci_lower, round(arg_max(km.ci_upper, km.time), 6) AS ci_upper, "
             "arg_max(km.n_at_risk, km.time) AS n_at_risk")


@register("survival_by_risk_group", RG_SQL.rstrip() + "," + km_sql("rg", ["risk_group"]) + f""",
h(time) AS (VALUES {_HV}),
p AS (SELECT DISTINCT risk_group, h.time FROM km, h)
SELECT p.risk_group, p.time, {_SAT_COLS}
FROM p JOIN km ON km.risk_group = p.risk_group AND km.time <= p.time GROUP BY p.risk_group, p.time""")
def survival_by_risk_group_q(spark, sf_dir):
    s = T.survival_by_group(_rg(spark, sf_dir), "risk_group", HZ)
    return s.select("risk_group", "time", *[r6(F.col(c)).alias(c) for c in ("survival", "ci_lower", "ci_upper")],
                    "n_at_risk")


@register("survival_summary", R.rstrip() + "," + km_sql("reorder", []) + """
SELECT (SELECT count(*) FROM reorder) AS n, (SELECT CAST(sum(e) AS BIGINT) FROM reorder) AS events,
       (SELECT max(t) FROM reorder) AS max_followup,
       coalesce(min(CASE WHEN survival <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_time,
       coalesce(min(CASE WHEN ci_lower <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_lower,
       coalesce(min(CASE WHEN ci_upper <= 0.5 THEN time END), 'inf'::DOUBLE) AS median_upper,
       round((SELECT sum(e) FROM reorder) / (SELECT count(*) FROM reorder), 6) AS event_rate
FROM km""")
def survival_summary_q(spark, sf_dir):
    s = T.survival_summary(fx.reorder(spark, sf_dir))
    return s.select("n", "events", "max_followup", "median_time", "median_lower", "median_upper",
                    r6(F.col("event_rate")).alias("event_rate"))


TREND_H = [30.0 * k for k in range(1, 13)]


@register("trend_table", R.rstrip() + "," + km_sql("reorder", []) + f""",
h(time) AS (SELECT CAST(30 * k AS DOUBLE) FROM range(1, 13) r(k))
SELECT h.time, {_SAT_COLS} FROM h JOIN km ON km.time <= h.time GROUP BY h.time""")
def trend_table_q(spark, sf_dir):
    s = T.trend_table(fx.reorder(spark, sf_dir), TREND_H)
    return s.select("time", *[r6(F.col(c)).alias(c) for c in ("survival", "ci_lower", "ci_upper")], "n_at_risk")


@register("performance_by_period", R.rstrip() + """,
p AS (SELECT reorder.*, CAST(year(o_orderdate) AS INTEGER) AS period FROM reorder JOIN orders ON o_orderkey = id),
pairs AS (
  SELECT a.period, a.price AS ra, b.price AS rb FROM p a JOIN p b ON a.period = b.period AND a.e = 1 AND b.t > a.t
  UNION ALL
  SELECT a.period, a.price, b.price FROM p a JOIN p b ON a.period = b.period AND a.e = 1 AND b.e = 0 AND b.t = a.t),
c AS (SELECT period, (count(*) FILTER (WHERE ra > rb) + 0.5 * count(*) FILTER (WHERE ra = rb)) / count(*) AS c_index
      FROM pairs GROUP BY period)
SELECT p.period, count(*) AS n, CAST(sum(e) AS BIGINT) AS events, round(any_value(c.c_index), 6) AS c_index
FROM p LEFT JOIN c ON c.period = p.period GROUP BY p.period""")
def performance_by_period_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"),
                                              F.year("o_orderdate").cast("int").alias("period"))
    df = fx.reorder(spark, sf_dir).join(o, "id").withColumn("risk", F.col("price"))
    p = T.performance_by_period(df, "period", "t", "e", "risk")
    return p.select("period", "n", "events", r6(F.col("c_index")).alias("c_index"))


@register("survival_curve_view", R.rstrip() + "," + km_sql("reorder", ["prio"]) + """
SELECT prio, time, round(survival, 6) AS survival, round(ci_lower, 6) AS lower, round(ci_upper, 6) AS upper,
       n_at_risk AS at_risk FROM km""")
def survival_curve_view_q(spark, sf_dir):
    c = risk.kaplan_meier(fx.reorder(spark, sf_dir), "t", "e", "prio")
    v = T.survival_curve_view(c, "prio")
    return v.select("prio", "time", *[r6(F.col(x)).alias(x) for x in ("survival", "lower", "upper")], "at_risk")


@register("transition_counts", J + """
SELECT state AS from_state, next_state AS to_state, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS probability
FROM journey WHERE next_state IS NOT NULL GROUP BY state, next_state""")
def transition_counts_q(spark, sf_dir):
    t = T.transition_counts(fx.journey(spark, sf_dir))
    return t.select("from_state", "to_state", "count", r6(F.col("probability")).alias("probability"))


@register("transition_view", J + """
SELECT state AS source, next_state AS target, count(*) AS value FROM journey WHERE next_state IS NOT NULL
GROUP BY state, next_state""")
def transition_view_q(spark, sf_dir):
    t = T.transition_counts(fx.journey(spark, sf_dir))
    return t.select(F.col("from_state").alias("source"), F.col("to_state").alias("target"),
                    F.col("count").alias("value"))


@register("risk_heatmap", R.rstrip() + """,
mm AS (SELECT min(price) a0, max(price) a1, min(t) b0, max(t) b1 FROM reorder),
c AS (SELECT CAST(least(floor((price - a0) / ((a1 - a0) / 5)), 4) AS INTEGER) AS bin_x,
             CAST(least(floor((t - b0) / ((b1 - b0) / 5)), 4) AS INTEGER) AS bin_y, e FROM reorder, mm)
SELECT bin_x, bin_y, round(avg(CAST(e AS DOUBLE)), 6) AS mean_risk, count(*) AS n,
       CASE WHEN avg(e) < 0.25 THEN 'low' WHEN avg(e) < 0.5 THEN 'medium_low' WHEN avg(e) < 0.75 THEN 'medium_high'
            ELSE 'high' END AS band
FROM c GROUP BY bin_x, bin_y""")
def risk_heatmap_q(spark, sf_dir):
    h = T.risk_heatmap(fx.reorder(spark, sf_dir), "price", "t", "e", 5)
    return h.select("bin_x", "bin_y", r6(F.col("mean_risk")).alias("mean_risk"), "n", "band")


@register("performance_by_period_metrics")
def performance_by_period_metrics_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"),
                                              F.year("o_orderdate").cast("int").alias("period"))
    df = fx.reused(fx.reorder(spark, sf_dir).join(o, "id").withColumn("risk", F.col("price")),
                   "seg", "t", "e", "risk", "period")
    curves = risk.kaplan_meier(df, "t", "e", "seg", with_ci=False)
    pred = risk.km_predictions(df, curves, "seg", [180.0])
    return T.period_metrics(pred, "period", 180.0, "S_0", "t", "e", "risk")


@register("risk_heatmap_quantile", R.rstrip() + """,
c AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS p, quantile_cont(t, [0.25, 0.5, 0.75]) AS q FROM reorder),
b AS (SELECT CAST(price > p[1] AS INT) + CAST(price > p[2] AS INT) + CAST(price > p[3] AS INT) AS bin_x,
             CAST(t > q[1] AS INT) + CAST(t > q[2] AS INT) + CAST(t > q[3] AS INT) AS bin_y, e FROM reorder, c),
m AS (SELECT bin_x, bin_y, avg(e) AS mean_risk, count(*) AS n FROM b GROUP BY ALL)
SELECT bin_x, bin_y, round(mean_risk, 6) AS mean_risk, n, CASE WHEN mean_risk < 0.25 THEN 'low' WHEN mean_risk < 0.5 THEN 'medium_low'
       WHEN mean_risk < 0.75 THEN 'medium_high' ELSE 'high' END AS band FROM m""")
def risk_heatmap_quantile_q(spark, sf_dir):
    h = T.risk_heatmap(fx.reorder(spark, sf_dir), "price", "t", "e", 4, binning="quantile")
    return h.select("bin_x", "bin_y", r6(F.col("mean_risk")).alias("mean_risk"), "n", "band")
