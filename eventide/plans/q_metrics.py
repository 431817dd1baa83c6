"""Registered queries: concordance, Brier, AUC and evaluation grids (E-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import metrics as M
from eventide.operators import risk
from eventide.operators.concordance import concordance_table
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register
from eventide.plans.sqlgen import km_sql

R = fx.with_ctes(fx.REORDER_SQL)
HZ = [90.0, 180.0, 365.0]
_HV = ", ".join(f"({h}::DOUBLE)" for h in HZ)

# censoring KM G(t) and G at the horizons, DuckDB side
G_SQL = f""",
g2 AS (SELECT CAST(t AS DOUBLE) AS time, sum(e) AS d, sum(1 - e) AS c, count(*) AS m FROM reorder GROUP BY 1),
r2 AS (SELECT *, sum(m) OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g2),
Gt AS (SELECT time, product(CASE WHEN n - d = 0 THEN 1.0 ELSE 1.0 - c / (n - d) END)
                OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS G FROM r2),
h(time) AS (VALUES {_HV}),
gh AS (SELECT h.time AS h, coalesce(arg_max(Gt.G, Gt.time), 1.0) AS gh
       FROM h LEFT JOIN Gt ON Gt.time <= h.time GROUP BY h.time),
x AS (SELECT reorder.*, Gt.G AS gt FROM reorder LEFT JOIN Gt ON Gt.time = reorder.t)"""


@register("concordance", R + """,
pairs AS (
  SELECT a.price AS ra, b.price AS rb FROM reorder a JOIN reorder b ON a.e = 1 AND b.t > a.t
  UNION ALL
  SELECT a.price, b.price FROM reorder a JOIN reorder b ON a.e = 1 AND b.e = 0 AND b.t = a.t),
cnt AS (SELECT CAST(count(*) FILTER (WHERE ra > rb) AS DOUBLE) AS concordant,
               CAST(count(*) FILTER (WHERE ra < rb) AS DOUBLE) AS discordant,
               CAST(count(*) FILTER (WHERE ra = rb) AS DOUBLE) AS tied_risk FROM pairs),
tt AS (SELECT CAST(sum(d * (d - 1) / 2) AS DOUBLE) AS tied_time
       FROM (SELECT count(*) AS d FROM reorder WHERE e = 1 GROUP BY t))
SELECT round((concordant + 0.5 * tied_risk) / (concordant + discordant + tied_risk), 6) AS c_index,
       concordant, discordant, tied_risk, tied_time, concordant + discordant + tied_risk AS comparable
FROM cnt, tt""".replace(R + ",", R.rstrip() + ","))
def concordance_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("t", "e", F.col("price").alias("risk"))
    c = concordance_table(df, "t", "e", "risk")
    return c.select(r6(F.col("c_index")).alias("c_index"), "concordant", "discordant", "tied_risk",
                    "tied_time", "comparable")


def _km_pred(spark, sf_dir, horizons):
    df = fx.reused(fx.reorder(spark, sf_dir), "seg", "t", "e")
    curves = risk.kaplan_meier(df, "t", "e", "seg", with_ci=False)
    return risk.km_predictions(df, curves, "seg", horizons)


_BRIER_SQL = R.rstrip() + "," + km_sql("reorder", ["seg"]) + G_SQL + """,
sp AS (SELECT km.seg, h.time AS h, arg_max(km.survival, km.time) AS s FROM h JOIN km ON km.time <= h.time
       GROUP BY km.seg, h.time)
SELECT gh.h AS time, round(avg(CASE WHEN x.t <= gh.h AND x.e = 1 THEN coalesce(sp.s * sp.s / nullif(x.gt, 0), 0)
                              WHEN x.t > gh.h THEN CASE WHEN gh.gh > 0 THEN (1 - sp.s) * (1 - sp.s) / gh.gh
                                                        ELSE 0 END
                              ELSE 0 END), 6) AS brier
FROM x JOIN sp ON sp.seg = x.seg JOIN gh ON gh.h = sp.h GROUP BY gh.h"""


@register("brier", _BRIER_SQL)
def brier_q(spark, sf_dir):
    pred = _km_pred(spark, sf_dir, HZ)
    b = M.brier_scores(pred, HZ, [f"S_{k}" for k in range(len(HZ))], "t", "e")
    return b.select("time", r6(F.col("brier")).alias("brier"))


_AUC_SQL = R.rstrip() + G_SQL + """,
xs AS (SELECT h.time AS h, x.price AS r,
              CASE WHEN x.t <= h.time AND x.e = 1 THEN coalesce(1.0 / nullif(x.gt, 0), 0) ELSE 0 END AS wc,
              CASE WHEN x.t > h.time THEN 1.0 ELSE 0 END AS nc FROM x, h),
gr AS (SELECT h, r, sum(wc) AS wc, sum(nc) AS nc FROM xs GROUP BY h, r),
cu AS (SELECT *, sum(nc) OVER (PARTITION BY h ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS nc_le FROM gr),
auc AS (SELECT h AS time, sum(wc * (nc_le - nc + 0.5 * nc)) / (sum(wc) * sum(nc)) AS auc FROM cu GROUP BY h)
"""


@register("dynamic_auc", _AUC_SQL + "SELECT time, round(auc, 6) AS auc FROM auc")
def dynamic_auc_q(spark, sf_dir):
    df = fx.reused(fx.reorder(spark, sf_dir).select("t", "e", F.col("price").alias("risk")))
    a = M.dynamic_auc(df, HZ, "risk", "t", "e")
    return a.select("time", r6(F.col("auc")).alias("auc"))


@register("integrated_auc", _AUC_SQL.rstrip() + "," + km_sql("reorder", [])
          .replace("\ng AS", "\ng AS").replace("r AS (", "r AS (") + """,
sk AS (SELECT h.time AS h, arg_max(km.survival, km.time) AS s FROM h JOIN km ON km.time <= h.time GROUP BY h.time),
j AS (SELECT auc.time, auc.auc, sk.s, coalesce(lag(sk.s) OVER (ORDER BY auc.time), 1.0) AS sprev
      FROM auc JOIN sk ON sk.h = auc.time)
SELECT round(sum(auc * (sprev - s)) / (1 - arg_max(s, time)), 6) AS integrated_auc FROM j""")
def integrated_auc_q(spark, sf_dir):
    df = fx.reused(fx.reorder(spark, sf_dir), "t", "e", "price")
    a = M.dynamic_auc(df.select("t", "e", F.col("price").alias("risk")), HZ, "risk", "t", "e")
    curve = risk.kaplan_meier(df, "t", "e", with_ci=False)
    s = {r["time"]: r["survival"] for r in risk.survival_at(curve, HZ, cols=["survival"]).collect()}
    v = M.integrated_auc(a, s)
    return a.agg(F.count(F.lit(1)).alias("_n")).select(F.round(F.lit(v), 6).alias("integrated_auc"))


_IBS_N = 100


@register("integrated_brier", R.rstrip() + "," + km_sql("reorder", ["seg"]) + G_SQL.replace(
    f"h(time) AS (VALUES {_HV})",
    f"""lim AS (SELECT min(t) AS lo, max(t) AS hi FROM reorder WHERE e = 1),
h(time) AS (SELECT lo + (hi - lo) * i / {_IBS_N - 1} FROM lim, range({_IBS_N}) r(i))""") + """,
sp AS (SELECT km.seg, h.time AS h, arg_max(km.survival, km.time) AS s FROM h JOIN km ON km.time <= h.time
       GROUP BY km.seg, h.time),
b AS (SELECT gh.h AS time, avg(CASE WHEN x.t <= gh.h AND x.e = 1 THEN coalesce(sp.s * sp.s / nullif(x.gt, 0), 0)
                              WHEN x.t > gh.h THEN CASE WHEN gh.gh > 0 THEN (1 - sp.s) * (1 - sp.s) / gh.gh
                                                        ELSE 0 END ELSE 0 END) AS brier
      FROM x JOIN sp ON sp.seg = x.seg JOIN gh ON gh.h = sp.h GROUP BY gh.h),
tr AS (SELECT time, brier, lead(time) OVER (ORDER BY time) AS t2, lead(brier) OVER (ORDER BY time) AS b2 FROM b)
SELECT round(sum((t2 - time) * (brier + b2) / 2) / (max(t2) - min(time)), 6) AS integrated_brier FROM tr""")
def integrated_brier_q(spark, sf_dir):
    df = fx.reused(fx.reorder(spark, sf_dir), "seg", "t", "e")
    grid = M.brier_grid(df, "t", "e", _IBS_N)
    curves = risk.kaplan_meier(df, "t", "e", "seg", with_ci=False)
    pred = risk.km_predictions(df, curves, "seg", grid)
    b = M.brier_scores(pred, grid, [f"S_{k}" for k in range(len(grid))], "t", "e")
    v = M.integrated_brier(b)
    return b.agg(F.count(F.lit(1)).alias("_n")).select(F.round(F.lit(v), 6).alias("integrated_brier"))


@register("evaluation_times", R + """
SELECT CAST(k AS INTEGER) AS k, q[k + 1] AS time
FROM (SELECT quantile_cont(t, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM reorder), range(5) r(k)""")
def evaluation_times_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    ts = M.evaluation_times(df, "t", "e")
    arr = F.array(*[F.lit(float(v)) for v in ts])
    return df.agg(F.count(F.lit(1)).alias("_n")).select(
        F.posexplode(arr).alias("k", "time")).select(F.col("k").cast("int"), "time")


@register("bootstrap_ci")
def bootstrap_ci_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "t", "e", F.col("price").alias("risk"))
    r = M.bootstrap_ci(df, "id", "t", "e", "risk", n_boot=100, seed=42)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(r["lower"]).alias("lower"), F.lit(r["upper"]).alias("upper"), F.lit(r["mean"]).alias("mean"))
