"""Registered queries: profiling and validation (P-rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import profile as P
from eventide.operators import validate as V
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register

D = fx.with_ctes(fx.DIRTY_SQL)
R = fx.with_ctes(fx.REORDER_SQL)

# (name, spark simpleString, numeric?) of the dirty fixture, in column order
DIRTY_COLS = [("id", "bigint", True), ("cluster", "bigint", True), ("seg", "string", False),
              ("price", "double", True), ("prio", "string", False), ("t", "double", True),
              ("status", "string", False), ("const_col", "double", True),
              ("price_copy", "double", True), ("cause", "int", True)]


def _has(name, words):
    return any(w in name.lower() for w in words)


def _stats_sql():
    parts = []
    for name, dt, num in DIRTY_COLS:
        x = f"CAST({name} AS DOUBLE)"
        stat = (f"min({x}), max({x}), avg({x}), median({x})" if num else
                "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE")
        temporal = _has(name, P.TEMPORAL_WORDS)
        parts.append(
            f"SELECT '{name}' AS column_name, '{dt}' AS dtype, {str(num).lower()} AS is_numeric, "
            f"{str(temporal).lower()} AS is_temporal, {str(num and _has(name, P.TTE_WORDS)).lower()} AS "
            f"is_time_to_event, {str(num and _has(name, P.EVENT_WORDS)).lower()} AS is_event_indicator, "
            f"count(*) - count({name}) AS missing, count(DISTINCT {name}) AS n_distinct, "
            f"{stat.split(', ')[0]} AS min, {stat.split(', ')[1]} AS max, {stat.split(', ')[2]} AS mean, "
            f"{stat.split(', ')[3]} AS median, count(*) AS n_rows FROM dirty")
    body = "\nUNION ALL ".join(parts)
    return D.rstrip() + f""",
s0 AS ({body}),
stats AS (SELECT *, (NOT is_numeric) AND (n_distinct / n_rows < {P.CATEGORICAL_RATIO}) AS is_categorical FROM s0)
"""


STATS_SQL = _stats_sql()


def _stats_out(df):
    return df.select("column_name", "dtype", "is_numeric", "is_categorical", "is_temporal",
                     "is_time_to_event", "is_event_indicator", "missing", "n_distinct",
                     *[r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "median")], "n_rows")


@register("column_stats", STATS_SQL + """
SELECT column_name, dtype, is_numeric, is_categorical, is_temporal, is_time_to_event, is_event_indicator,
       missing, n_distinct, round(min, 6) AS min, round(max, 6) AS max, round(mean, 6) AS mean,
       round(median, 6) AS median, n_rows FROM stats""")
def column_stats_q(spark, sf_dir):
    return _stats_out(P.column_stats(fx.dirty(spark, sf_dir), exact=True))


_ROLE_VIEW_COLS = ["id", "price AS order_value", "t AS survival_time", "e AS event_status",
                   "cause AS death_cause", "seg"]
_ROLE_VIEW = "SELECT " + ", ".join(_ROLE_VIEW_COLS) + " FROM reorder"


def _role_sql():
    cols = ["id", "order_value", "survival_time", "event_status", "death_cause", "seg"]
    parts = []
    for c in cols:
        num = f"(SELECT typeof({c}) FROM v LIMIT 1) IN ('DOUBLE', 'BIGINT', 'INTEGER')"
        tw = " OR ".join(f"contains(lower('{c}'), '{w}')" for w in P.TTE_WORDS)
        ew = " OR ".join(f"contains(lower('{c}'), '{w}')" for w in P.EVENT_WORDS)
        parts.append(f"SELECT 'time' AS role, '{c}' AS column_name WHERE {num} AND ({tw})")
        parts.append(f"SELECT 'event' AS role, '{c}' AS column_name WHERE {num} AND ({ew})")
    return R.rstrip() + f""",
v AS ({_ROLE_VIEW})
""" + "\nUNION ALL ".join(parts)


@register("role_candidates", _role_sql())
def role_candidates_q(spark, sf_dir):
    return P.role_candidates(P.column_stats(fx.reorder(spark, sf_dir).selectExpr(*_ROLE_VIEW_COLS), exact=True))


@register("dataset_summary", STATS_SQL + """
SELECT max(n_rows) AS total_rows, count(*) AS total_columns,
       count(CASE WHEN is_numeric THEN 1 END) AS numeric_columns,
       count(CASE WHEN is_categorical THEN 1 END) AS categorical_columns,
       count(CASE WHEN missing > 0 THEN 1 END) AS columns_with_missing,
       CAST(sum(missing) AS BIGINT) AS missing_cells,
       round(100.0 * sum(missing) / (max(n_rows) * count(*)), 6) AS missing_percent FROM stats""")
def dataset_summary_q(spark, sf_dir):
    return P.dataset_summary(P.column_stats(fx.dirty(spark, sf_dir), exact=True))


@register("column_groups", STATS_SQL + f"""
SELECT 'categorical' AS "group", column_name FROM stats WHERE is_categorical
UNION ALL SELECT 'numerical', column_name FROM stats WHERE is_numeric
UNION ALL SELECT 'temporal', column_name FROM stats WHERE is_temporal
UNION ALL SELECT 'missing', column_name FROM stats WHERE missing > 0
UNION ALL SELECT 'high_cardinality', column_name FROM stats
  WHERE NOT is_numeric AND n_distinct / n_rows > {P.HIGH_CARDINALITY_RATIO}""")
def column_groups_q(spark, sf_dir):
    return P.column_groups(P.column_stats(fx.dirty(spark, sf_dir), exact=True))


_ROLE_COLS = ["id", "price", "t AS survival_time", "e AS event_status", "cause"]
_ROLE_SRC = "SELECT " + ", ".join(_ROLE_COLS) + " FROM reorder"


@register("detect_survival_columns", R.rstrip() + f""",
v AS ({_ROLE_SRC})
SELECT 'survival_time' AS time_column,
  CASE WHEN bool_and(event_status IN (0, 1)) OR bool_and(event_status IN (0, 1, 2)) THEN 'event_status'
       WHEN count(DISTINCT id) BETWEEN 2 AND 3 THEN 'id'
       WHEN count(DISTINCT price) BETWEEN 2 AND 3 THEN 'price'
       WHEN count(DISTINCT event_status) BETWEEN 2 AND 3 THEN 'event_status' END AS event_column
FROM v""")
def detect_survival_columns_q(spark, sf_dir):
    v = fx.reorder(spark, sf_dir).selectExpr(*_ROLE_COLS)
    roles = P.detect_survival_columns(v)
    # one-row result carried by a Spark aggregate over the same table
    return v.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(roles["time"]).alias("time_column"), F.lit(roles["event"]).alias("event_column"))


@register("histogram", D.rstrip() + """,
mm AS (SELECT min(price) AS lo, max(price) AS hi FROM dirty),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 1.0 END AS width FROM mm),
b AS (SELECT CAST(CASE WHEN price >= hi THEN 9 ELSE floor((price - lo) / width) END AS INTEGER) AS bin
      FROM dirty, w WHERE price IS NOT NULL),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT g.bin, round(lo + g.bin * width, 6) AS bin_lower, round(lo + (g.bin + 1) * width, 6) AS bin_upper,
       coalesce(cnt, 0) AS count
FROM g CROSS JOIN w LEFT JOIN c ON c.bin = g.bin""")
def histogram_q(spark, sf_dir):
    h = P.histogram(fx.dirty(spark, sf_dir), "price", 10)
    return h.select("bin", r6(F.col("bin_lower")).alias("bin_lower"),
                    r6(F.col("bin_upper")).alias("bin_upper"), "count")


def _shape_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name,
  (SELECT avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) FROM dirty, (SELECT avg({c}) m FROM dirty)) AS skewness,
  (SELECT avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3 FROM dirty, (SELECT avg({c}) m FROM dirty)) AS kurtosis,
  (SELECT count(*) FROM dirty, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM dirty)
     WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count""")
    return D + "SELECT column_name, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, " \
               "outlier_count FROM (" + " UNION ALL ".join(parts) + ")"


@register("shape_stats", _shape_sql(["price", "t"]))
def shape_stats_q(spark, sf_dir):
    s = P.shape_stats(fx.dirty(spark, sf_dir), ["price", "t"])
    return s.select("column_name", r6(F.col("skewness")).alias("skewness"),
                    r6(F.col("kurtosis")).alias("kurtosis"), "outlier_count")


@register("top_values", D + """
SELECT prio AS value, count(*) AS count FROM dirty GROUP BY prio ORDER BY count DESC, value NULLS LAST LIMIT 3""")
def top_values_q(spark, sf_dir):
    return P.top_values(fx.dirty(spark, sf_dir), "prio", 3)


_CORR = ["price", "t", "price_copy", "cause"]


@register("correlation_matrix", D + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r "
    f"FROM dirty" for i, a in enumerate(_CORR) for b in _CORR[i:]) + ")")
def correlation_matrix_q(spark, sf_dir):
    c = P.correlation_matrix(fx.dirty(spark, sf_dir), _CORR)
    return c.select("col_a", "col_b", r6(F.col("r")).alias("r"))


@register("preview", R + "SELECT id, cluster, seg, round(price, 6) AS price, prio, t, e, cause "
                         "FROM reorder ORDER BY id LIMIT 10")
def preview_q(spark, sf_dir):
    p = P.preview(fx.reorder(spark, sf_dir), "id", 10)
    return p.select("id", "cluster", "seg", r6(F.col("price")).alias("price"), "prio", "t", "e", "cause")


@register("event_distribution", R + """
SELECT e AS event, count(*) AS count, round(count(*) / (SELECT count(*) FROM reorder), 6) AS share
FROM reorder GROUP BY e""")
def event_distribution_q(spark, sf_dir):
    d = P.event_distribution(fx.reorder(spark, sf_dir), "e")
    return d.select("event", "count", r6(F.col("share")).alias("share"))


@register("population_summary", R + """
SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS events, median(t) AS median_followup,
       round(avg(CASE WHEN prio IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END), 6) AS group_ratio,
       round(min(price), 6) AS price_min, round(max(price), 6) AS price_max,
       round(median(price), 6) AS price_median FROM reorder""")
def population_summary_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).withColumn("urgent", F.expr("prio IN ('1-URGENT', '2-HIGH')").cast("int"))
    s = P.population_summary(df, "t", "e", "urgent", ["price"])
    return s.select("n", "events", "median_followup", r6(F.col("group_ratio")).alias("group_ratio"),
                    *[r6(F.col(c)).alias(c) for c in ("price_min", "price_max", "price_median")])


def _validate_sql():
    miss = " UNION ALL ".join(
        f"SELECT 'missing_values' AS issue_type, '{c}' AS column_name, "
        f"'{'error' if c == 't' else 'warning'}' AS severity, count(*) - count({c}) AS affected_rows "
        f"FROM dirty HAVING count(*) - count({c}) > 0" for c, _, _ in DIRTY_COLS)
    nums = [c for c, _, n in DIRTY_COLS if n]
    outl = " UNION ALL ".join(
        f"SELECT 'outliers', '{c}', 'info', count(*) FROM dirty, "
        f"(SELECT avg(CAST({c} AS DOUBLE)) mu, stddev_samp(CAST({c} AS DOUBLE)) sd FROM dirty) "
        f"WHERE sd > 0 AND abs(({c} - mu) / sd) > 3.0 HAVING count(*) > 0" for c in nums)
    return D + f"""SELECT * FROM ({miss}
UNION ALL SELECT 'incorrect_format', 't', 'error', count(*) FROM dirty WHERE t <= 0 HAVING count(*) > 0
UNION ALL SELECT 'incorrect_format', 'cause', 'error', count(*) FROM dirty
  WHERE CAST(cause AS DOUBLE) NOT IN (0.0, 1.0) HAVING count(*) > 0
UNION ALL {outl})"""


@register("validate_sample_keys")
def validate_sample_keys_q(spark, sf_dir):
    return V.validate(fx.dirty(spark, sf_dir), time="t", event="cause", key="id", sample_size=5)


@register("validate", _validate_sql())
def validate_q(spark, sf_dir):
    v = V.validate(fx.dirty(spark, sf_dir), time="t", event="cause")
    return v.select("issue_type", "column_name", "severity", "affected_rows")


@register("validate_survival", R + """
SELECT count(*) AS rows, count(CASE WHEN t IS NULL OR isnan(t) THEN 1 END) AS null_time,
  count(CASE WHEN e IS NULL THEN 1 END) AS null_event, count(CASE WHEN t <= 0 THEN 1 END) AS nonpositive_time,
  count(CASE WHEN t = 'inf'::DOUBLE THEN 1 END) AS infinite_time,
  count(CASE WHEN CAST(e AS DOUBLE) NOT IN (0.0, 1.0) THEN 1 END) AS bad_event FROM reorder""")
def validate_survival_q(spark, sf_dir):
    df = V.validate_survival(fx.reorder(spark, sf_dir), "t", "e")
    t = F.col("t")
    e = F.col("e").cast("double")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count(F.when(t.isNull() | F.isnan(t), 1)).alias("null_time"),
                  F.count(F.when(F.col("e").isNull(), 1)).alias("null_event"),
                  F.count(F.when(t <= 0, 1)).alias("nonpositive_time"),
                  F.count(F.when(t == float("inf"), 1)).alias("infinite_time"),
                  F.count(F.when(~e.isin(0.0, 1.0), 1)).alias("bad_event"))
