"""Registered queries: log-rank tests and competing-risk estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import aj, logrank
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register

R = fx.with_ctes(fx.REORDER_SQL)

# two groups: urgent/high priority vs the rest
_URGENT = "prio IN ('1-URGENT', '2-HIGH')"

_POOLED = R.rstrip() + """,
src AS (SELECT t, e, {grp} AS grp FROM reorder),
tm AS (SELECT DISTINCT t AS time FROM src),
atr AS (SELECT tm.time, src.grp, count(*) AS n_g,
              sum(CASE WHEN src.t = tm.time THEN src.e ELSE 0 END) AS d_g
       FROM tm JOIN src ON src.t >= tm.time GROUP BY tm.time, src.grp),
tot AS (SELECT time, sum(n_g) AS n, sum(d_g) AS d FROM atr GROUP BY time)
"""


@register("logrank_stat", _POOLED.format(grp=_URGENT) + """
, x AS (SELECT tot.time, tot.n, tot.d, coalesce(a.n_g, 0) AS n1, coalesce(a.d_g, 0) AS d1
        FROM tot LEFT JOIN atr a ON a.time = tot.time AND a.grp = false)
SELECT round(CAST(sum(d1) AS DOUBLE), 6) AS observed, round(sum(d * n1 / n), 6) AS expected,
       round(sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1.0) ELSE 0 END * (n1 / n) * (1 - n1 / n)), 6)
         AS variance,
       round(pow(sum(d1) - sum(d * n1 / n), 2) /
             sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1.0) ELSE 0 END * (n1 / n) * (1 - n1 / n)), 6)
         AS statistic
FROM x""")
def logrank_stat(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).withColumn("grp", F.expr(_URGENT))
    out = logrank.logrank_two_sample(df, "grp")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@register("logrank_multi_oe", _POOLED.format(grp="seg") + """
, g AS (SELECT DISTINCT grp FROM src),
x AS (SELECT g.grp, tot.time, tot.n, tot.d, coalesce(a.n_g, 0) AS ng, coalesce(a.d_g, 0) AS dg
      FROM tot CROSS JOIN g LEFT JOIN atr a ON a.time = tot.time AND a.grp = g.grp)
SELECT grp AS seg, round(CAST(sum(dg) AS DOUBLE), 6) AS observed, round(sum(d * ng / n), 6) AS expected
FROM x GROUP BY grp""")
def logrank_multi_oe(spark, sf_dir):
    out = logrank.logrank_table(fx.reorder(spark, sf_dir), "seg")
    return out.select("seg", r6(F.col("observed")).alias("observed"),
                      r6(F.col("expected")).alias("expected"))


_AJ_SQL = R.rstrip() + """,
g AS (SELECT CAST(t AS DOUBLE) AS time, sum(CASE WHEN cause <> 0 THEN 1 ELSE 0 END) AS d, count(*) AS m,
             sum(CASE WHEN cause = 1 THEN 1 ELSE 0 END) AS d1, sum(CASE WHEN cause = 2 THEN 1 ELSE 0 END) AS d2,
             sum(CASE WHEN cause = 3 THEN 1 ELSE 0 END) AS d3
      FROM reorder GROUP BY 1),
r AS (SELECT *, sum(m) OVER (ORDER BY time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g),
s AS (SELECT *, coalesce(product(1.0 - d / n) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING
                  AND 1 PRECEDING), 1.0) AS s_prev FROM r),
c AS (SELECT time, s_prev * (1.0 - d / n) AS s,
        sum(s_prev * d1 / n) OVER w AS cif_1, sum(s_prev * d2 / n) OVER w AS cif_2,
        sum(s_prev * d3 / n) OVER w AS cif_3
      FROM s WINDOW w AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
aj AS (SELECT time, 0 AS state, s AS probability FROM c UNION ALL SELECT time, 1, cif_1 FROM c
       UNION ALL SELECT time, 2, cif_2 FROM c UNION ALL SELECT time, 3, cif_3 FROM c)
"""


@register("aalen_johansen", _AJ_SQL + "SELECT time, state, round(probability, 6) AS probability FROM aj")
def aalen_johansen_q(spark, sf_dir):
    out = aj.aalen_johansen(fx.reorder(spark, sf_dir), "t", "cause")
    return out.select("time", "state", r6(F.col("probability")).alias("probability"))


@register("aj_summary", _AJ_SQL + """
SELECT state, round(arg_max(probability, time), 6) AS final_probability, count(*) AS n_times,
  (SELECT coalesce(min(CASE WHEN probability <= 0.5 THEN time END), 'nan'::DOUBLE) FROM aj WHERE state = 0)
    AS median_stay
FROM aj GROUP BY state""")
def aj_summary_q(spark, sf_dir):
    out = aj.aj_summary(aj.aalen_johansen(fx.reorder(spark, sf_dir), "t", "cause"))
    return out.select("state", r6(F.col("final_probability")).alias("final_probability"),
                      "n_times", "median_stay")


@register("logrank_multi")
def logrank_multi_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    r = logrank.logrank(df, "seg")
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(float(r["statistic"])).alias("statistic"), F.lit(int(r["df"])).alias("df"),
        F.lit(float(r["p_value"])).alias("p_value"))
