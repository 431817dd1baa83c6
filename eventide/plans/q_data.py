"""Registered queries: relational operators, cleaning, features and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.operators import clean as C
from eventide.operators import features as X
from eventide.operators import relational as Rl
from eventide.operators import split as S
from eventide.plans import fixtures as fx
from eventide.plans.registry import r6, register
from eventide.sources.tables import table

D = fx.with_ctes(fx.DIRTY_SQL)
R = fx.with_ctes(fx.REORDER_SQL)
J = fx.with_ctes(fx.JOURNEY_SQL)
KEY = "CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT)"


# ---- R-rows -------------------------------------------------------------

@register("filter_by", R + "SELECT id, seg, prio, t, e FROM reorder "
                           "WHERE seg = 'BUILDING' AND prio IN ('1-URGENT', '2-HIGH')")
def filter_by_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "seg", "prio", "t", "e")
    return Rl.filter_by(df, {"seg": "BUILDING", "prio": ["1-URGENT", "2-HIGH"], "no_such_col": 1})


@register("search", "SELECT c_custkey, c_name, c_mktsegment FROM customer "
                    "WHERE lower(c_mktsegment) LIKE '%ing%' OR lower(c_name) LIKE '%ing%'")
def search_q(spark, sf_dir):
    """One case-insensitive term, ORed over the listed columns."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return Rl.search(c, "ING", ["c_mktsegment", "c_name"])


@register("search_any", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders "
                        "WHERE lower(o_orderpriority) LIKE '%urg%' OR lower(o_orderstatus) LIKE '%urg%'")
def search_any_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return Rl.search_any(o, "URG")


@register("sort_by", "SELECT o_orderkey, o_totalprice FROM orders")
def sort_by_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return Rl.sort_by(o, "o_totalprice", "desc", "o_orderkey")


@register("page", """
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total,
       CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS total_pages
FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def page_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows, meta = Rl.page(o, 3, 20, ["o_orderkey"])
    return rows.select("o_orderkey", "o_custkey", F.lit(meta["total"]).cast("long").alias("total"),
                       F.lit(meta["total_pages"]).cast("long").alias("total_pages"))


@register("range_filter", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'
  AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_totalprice <= 100000""")
def range_filter_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    out = Rl.range_filter(o, "o_orderdate", ("1996-01-01", "1996-12-31"), "o_orderstatus", ["F", "O"],
                          "o_totalprice", 1000, 100000, sort="o_totalprice")
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("status_counts", "SELECT o_orderstatus AS status, count(*) AS count FROM orders GROUP BY 1")
def status_counts_q(spark, sf_dir):
    return Rl.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@register("recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def recent_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return Rl.recent(o, "o_orderdate", 5, "o_orderkey")


@register("accessible", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'
   OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 AND l_linestatus = 'O')""")
def accessible_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority") \
        .withColumn("is_public", F.col("o_orderpriority") == "1-URGENT")
    acl = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", (F.col("l_linestatus") == "O").alias("can_read"))
    out = Rl.accessible(o, acl, 7, key="o_orderkey", owner="o_custkey", public="is_public",
                        acl_user="l_suppkey", acl_key="l_orderkey", right="can_read")
    return out.select("o_orderkey", "o_custkey", "o_orderpriority")


@register("drop_columns", R + "SELECT id, cluster, seg, t, e, cause FROM reorder")
def drop_columns_q(spark, sf_dir):
    return Rl.drop_columns(fx.reorder(spark, sf_dir), ["price", "prio", "not_there"])


@register("project_roles", R + "SELECT id, round(price, 6) AS price, cause, t, e FROM reorder")
def project_roles_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).withColumn("price", r6(F.col("price")))
    return Rl.project_roles(df, "t", "e", ["price", "cause"], keep=["id"])


# ---- J / U rows ---------------------------------------------------------

@register("lookup_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def lookup_name_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer")
    return Rl.lookup_name(o, c, "o_custkey", "c_custkey", "c_name").select("o_orderkey", "c_name")


@register("split_by_ids", R + f"""
SELECT 'train' AS part, count(*) AS n, CAST(sum(e) AS BIGINT) AS events FROM reorder
  WHERE id IN (SELECT id FROM reorder WHERE {KEY} / 4294967296.0 >= 0.2)
UNION ALL SELECT 'test', count(*), CAST(sum(e) AS BIGINT) FROM reorder
  WHERE id IN (SELECT id FROM reorder WHERE {KEY} / 4294967296.0 < 0.2)""")
def split_by_ids_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    tr_ids, te_ids = S.random_split(df.select("id"), "id", 0.2, 42)
    tr, te = Rl.split_by_ids(df, "id", tr_ids, te_ids)
    agg = [F.count(F.lit(1)).alias("n"), F.sum("e").cast("long").alias("events")]
    return tr.agg(*agg).select(F.lit("train").alias("part"), "*").unionByName(
        te.agg(*agg).select(F.lit("test").alias("part"), "*"))


@register("attach_features", R + """
SELECT id, t, e, count(*) AS n_lines, round(sum(l_quantity), 6) AS qty
FROM reorder JOIN lineitem ON l_orderkey = id GROUP BY id, t, e""")
def attach_features_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "t", "e")
    feats = (table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
             .agg(F.count(F.lit(1)).alias("n_lines"), r6(F.sum("l_quantity")).alias("qty")))
    return Rl.attach_features(df, feats, "id")


@register("union_rows", R + "SELECT id, seg FROM reorder")
def union_rows_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "seg")
    return Rl.union_rows(df.where("seg = 'BUILDING'"), df.where("seg <> 'BUILDING'"))


@register("time_grid_union", R + "SELECT DISTINCT CAST(t AS DOUBLE) AS time FROM reorder")
def time_grid_union_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir)
    return Rl.time_grid_union(df.where("cause = 1").select(F.col("t").alias("time")),
                              df.where("cause <> 1").select(F.col("t").alias("time")))


@register("distinct_transitions", J + "SELECT DISTINCT state AS from_state, next_state AS to_state "
                                      "FROM journey WHERE next_state IS NOT NULL")
def distinct_transitions_q(spark, sf_dir):
    return Rl.distinct_transitions(fx.journey(spark, sf_dir))


@register("distinct_states", J + "SELECT state FROM journey UNION "
                                 "SELECT next_state FROM journey WHERE next_state IS NOT NULL")
def distinct_states_q(spark, sf_dir):
    return Rl.distinct_states(fx.journey(spark, sf_dir))


# ---- X rows ------------------------------------------------------------

@register("impute_mean", D + "SELECT id, round(coalesce(price, (SELECT avg(price) FROM dirty)), 6) AS price "
                             "FROM dirty")
def impute_mean_q(spark, sf_dir):
    d = C.impute(fx.dirty(spark, sf_dir).select("id", "price"), "mean", ["price"])
    return d.select("id", r6(F.col("price")).alias("price"))


@register("impute_median", D + "SELECT id, round(coalesce(price, (SELECT median(price) FROM dirty)), 6) "
                               "AS price FROM dirty")
def impute_median_q(spark, sf_dir):
    d = C.impute(fx.dirty(spark, sf_dir).select("id", "price"), "median", ["price"])
    return d.select("id", r6(F.col("price")).alias("price"))


@register("impute_zero", D + "SELECT id, round(coalesce(price, 0.0), 6) AS price FROM dirty")
def impute_zero_q(spark, sf_dir):
    d = C.impute(fx.dirty(spark, sf_dir).select("id", "price"), "zero", ["price"])
    return d.select("id", r6(F.col("price")).alias("price"))


@register("impute_mode", D + """SELECT id, coalesce(prio, (SELECT prio FROM dirty WHERE prio IS NOT NULL
  GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)) AS prio FROM dirty""")
def impute_mode_q(spark, sf_dir):
    return C.impute(fx.dirty(spark, sf_dir).select("id", "prio"), "mode", ["prio"])


@register("impute_empty_string", D + "SELECT id, coalesce(prio, '') AS prio FROM dirty")
def impute_empty_q(spark, sf_dir):
    return C.impute(fx.dirty(spark, sf_dir).select("id", "prio"), "empty_string", ["prio"])


@register("normalize_min_max", R + """
SELECT id, round((price - mn) / (mx - mn), 6) AS price, round((cause - cmn) / (cmx - cmn), 6) AS cause
FROM reorder, (SELECT min(price) mn, max(price) mx, min(cause) cmn, max(cause) cmx FROM reorder)""")
def normalize_min_max_q(spark, sf_dir):
    d = C.normalize(fx.reorder(spark, sf_dir).select("id", "price", "cause"), "min_max", exclude=["id"])
    return d.select("id", r6(F.col("price")).alias("price"), r6(F.col("cause")).alias("cause"))


@register("normalize_z_score", R + """
SELECT id, round((price - m) / s, 6) AS price, t
FROM reorder, (SELECT avg(price) m, stddev_samp(price) s FROM reorder)""")
def normalize_z_q(spark, sf_dir):
    d = C.normalize(fx.reorder(spark, sf_dir).select("id", "price", "t"), "z_score", exclude=["id", "t"])
    return d.select("id", r6(F.col("price")).alias("price"), "t")


def _onehot_sql():
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    cols = ", ".join(f"CASE WHEN seg = '{s}' THEN 1 ELSE 0 END AS \"seg_{s}\"" for s in segs)
    return D + f"SELECT id, {cols}, round(price, 6) AS price FROM dirty"


@register("one_hot", _onehot_sql())
def one_hot_q(spark, sf_dir):
    d = fx.dirty(spark, sf_dir).select("id", "seg", r6(F.col("price")).alias("price"))
    return C.one_hot(d, ["seg"])


@register("label_encode", D + """
SELECT id, CAST(coalesce(code, -1) AS INTEGER) AS prio FROM dirty
LEFT JOIN (SELECT prio AS lv, dense_rank() OVER (ORDER BY prio) - 1 AS code
           FROM (SELECT DISTINCT prio FROM dirty WHERE prio IS NOT NULL)) ON lv = prio""")
def label_encode_q(spark, sf_dir):
    return C.label_encode(fx.dirty(spark, sf_dir).select("id", "prio"), ["prio"])


@register("encode_event", D + "SELECT id, CASE lower(trim(status)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END "
                              "AS status FROM dirty")
def encode_event_q(spark, sf_dir):
    return C.encode_event(fx.dirty(spark, sf_dir).select("id", "status"), "status")


@register("scale", R + "SELECT id, round((price - m) / s, 6) AS price FROM reorder, "
                       "(SELECT avg(price) m, stddev_pop(price) s FROM reorder)")
def scale_q(spark, sf_dir):
    d = fx.reorder(spark, sf_dir).select("id", "price")
    out = C.apply_scaler(d, C.fit_scaler(d, ["price"]))
    return out.select("id", r6(F.col("price")).alias("price"))


@register("pairwise_features", R + """
SELECT id, round(cause + price, 6) AS ft_cause_plus_price, round(cause * price, 6) AS ft_cause_times_price,
       round(cause / price, 6) AS ft_cause_div_price FROM reorder""")
def pairwise_features_q(spark, sf_dir):
    d = X.pairwise_features(fx.reorder(spark, sf_dir).select("id", "price", "cause"), exclude=["id"])
    return d.select("id", *[r6(F.col(c)).alias(c) for c in d.columns if c.startswith("ft_")])


@register("series_features", R + """
SELECT id, round(s, 2) AS ts_price_sum, round(md, 6) AS ts_price_median, round(mu, 6) AS ts_price_mean,
  n AS ts_price_length, round(sd, 6) AS ts_price_std, round(v, 2) AS ts_price_var, round(rms, 6) AS ts_price_rms,
  round(mx, 6) AS ts_price_max, round(amx, 6) AS ts_price_abs_max, round(mn, 6) AS ts_price_min
FROM reorder, (SELECT sum(price) s, median(price) md, avg(price) mu, count(price) n, stddev_pop(price) sd,
  var_pop(price) v, sqrt(avg(price * price)) rms, max(price) mx, max(abs(price)) amx, min(price) mn FROM reorder)""")
def series_features_q(spark, sf_dir):
    d = X.series_features(fx.reorder(spark, sf_dir).select("id", "price"), ["price"])
    cols = [F.col(c) if c.endswith("length") else
            F.round(F.col(c), 2).alias(c) if c.endswith(("_var", "_sum")) else r6(F.col(c)).alias(c)
            for c in d.columns if c.startswith("ts_")]
    return d.select("id", *cols)


@register("interaction_features", R + """
SELECT id, round(cluster * price, 6) AS interaction_cluster_x_price,
       round(CAST(cluster * cause AS DOUBLE), 6) AS interaction_cluster_x_cause, round(price * cause, 6) AS interaction_price_x_cause
FROM reorder""")
def interaction_features_q(spark, sf_dir):
    d = X.interaction_features(fx.reorder(spark, sf_dir).select("id", "cluster", "price", "cause"),
                               exclude=["id"])
    return d.select("id", *[r6(F.col(c)).alias(c) for c in d.columns if c.startswith("interaction_")])


@register("polynomial_features", R + "SELECT id, round(price * price, 2) AS price_squared, "
                                     "round(CAST(cause * cause AS DOUBLE), 6) AS cause_squared FROM reorder")
def polynomial_features_q(spark, sf_dir):
    d = X.polynomial_features(fx.reorder(spark, sf_dir).select("id", "price", "cause"), exclude=["id"])
    # squares reach 1e11: round to 2 decimals so both engines' rounding agree
    return d.select("id", *[F.round(F.col(c), 2).alias(c) for c in d.columns if c.endswith("_squared")])


@register("random_split", R + f"SELECT id, CAST({KEY} / 4294967296.0 < 0.2 AS INTEGER) AS is_test FROM reorder")
def random_split_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id")
    tr, te = S.random_split(df, "id", 0.2, 42)
    return tr.select("id", F.lit(0).alias("is_test")).unionByName(te.select("id", F.lit(1).alias("is_test")))


@register("stratified_split", R + f"""
SELECT id, e, CAST(row_number() OVER (PARTITION BY e ORDER BY {KEY}, id)
          <= floor(count(*) OVER (PARTITION BY e) * 0.25 + 0.5) AS INTEGER) AS is_test FROM reorder""")
def stratified_split_q(spark, sf_dir):
    df = fx.reorder(spark, sf_dir).select("id", "e")
    tr, te = S.stratified_split(df, "e", "id", 0.25, 42)
    return tr.withColumn("is_test", F.lit(0)).unionByName(te.withColumn("is_test", F.lit(1)))


@register("kfold", R + f"SELECT id, CAST({KEY} % 5 AS INTEGER) AS fold FROM reorder")
def kfold_q(spark, sf_dir):
    return S.kfold(fx.reorder(spark, sf_dir).select("id"), 5, "id", 42)


@register("time_bins", R + """
SELECT id, CAST(least(greatest(ceil(t / (mx / 10)), 1), 10) AS INTEGER) AS interval
FROM reorder, (SELECT max(t) mx FROM reorder)""")
def time_bins_q(spark, sf_dir):
    d, _ = X.time_bins(fx.reorder(spark, sf_dir).select("id", "t"), "t", 10)
    return d.select("id", "interval")


@register("person_period", R + """
, b AS (SELECT id, e, CAST(least(greatest(ceil(t / (mx / 10)), 1), 10) AS INTEGER) AS interval
        FROM reorder, (SELECT max(t) mx FROM reorder)),
pp AS (SELECT id, e, interval, unnest(range(1, interval + 1)) AS period FROM b)
SELECT CAST(period AS INTEGER) AS period, count(*) AS n,
       CAST(sum(CASE WHEN period = interval AND e = 1 THEN 1 ELSE 0 END) AS BIGINT) AS events
FROM pp GROUP BY period""".replace(R + "\n,", R.rstrip() + ","))
def person_period_q(spark, sf_dir):
    pp = X.person_period(fx.reorder(spark, sf_dir).select("id", "t", "e"), "t", "e", 10)
    return pp.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("events"))
