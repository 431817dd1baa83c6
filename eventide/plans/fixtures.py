"""Survival tables derived from the driver tables, in Spark and in DuckDB SQL.

* ``reorder`` — per order, days until the same customer's next order (+1);
  censored at 2001-08-02; strata ``seg``, cause = status of the next order,
  cluster = customer.
* ``journey`` — multi-state moves from ``events``: state = event type,
  next_state = following event type of the same user, ``t`` hours between.
* ``first_purchase`` — hours from a user's first event to the first purchase,
  administratively censored at 24 h.
* ``dirty`` — ``reorder`` with nulls, string events, a constant and a
  duplicated column injected (the driver tables have no nulls).

The SQL strings are the same definitions for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.plans.scan import split_lead
from eventide.sources.tables import table

# Fixed values of the fixtures.
CENSOR_DATE = "2001-08-02"
JOURNEY_END = "2024-01-31 00:00:00"
PURCHASE_HORIZON_H = 24.0


def reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner").withColumn("d0", F.to_date("o_orderdate"))
    # lead over each customer's orders, split so a heavy customer is not one task
    j = split_lead(j, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["d0", "o_orderstatus"])
    j = j.withColumnRenamed("d0_next", "d1").withColumnRenamed("o_orderstatus_next", "st")
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cluster"),
        F.col("c_mktsegment").alias("seg"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("prio"),
        (F.datediff(F.coalesce(F.col("d1"), F.lit(CENSOR_DATE).cast("date")), F.col("d0"))
         .cast("double") + 1.0).alias("t"),
        F.col("d1").isNotNull().cast("int").alias("e"),
        F.when(F.col("st") == "F", 1).when(F.col("st") == "O", 2)
         .when(F.col("st") == "P", 3).otherwise(0).alias("cause"),
    )


REORDER_SQL = f"""
reorder AS (
  WITH o AS (
    SELECT o_orderkey AS id, o_custkey AS cluster, c_mktsegment AS seg, o_totalprice AS price,
           o_orderpriority AS prio, CAST(o_orderdate AS DATE) AS d0,
           lead(CAST(o_orderdate AS DATE)) OVER w AS d1, lead(o_orderstatus) OVER w AS st
    FROM orders JOIN customer ON o_custkey = c_custkey
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
  SELECT id, cluster, seg, price, prio,
         CAST(date_diff('day', d0, coalesce(d1, DATE '{CENSOR_DATE}')) AS DOUBLE) + 1 AS t,
         CAST(d1 IS NOT NULL AS INTEGER) AS e,
         CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 0 END AS cause
  FROM o)"""


def journey(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    j = split_lead(ev, ["user_id"], ["ts", "event_id"], ["event_type", "ts"])
    j = j.withColumnRenamed("event_type_next", "next_state").withColumnRenamed("ts_next", "next_ts")
    end = F.coalesce(F.col("next_ts").cast("timestamp"), F.lit(JOURNEY_END).cast("timestamp"))
    return j.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("state"), "next_state",
        ((F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("t"),
        F.col("next_ts").isNotNull().cast("int").alias("e"),
        F.col("value"),
    )


JOURNEY_SQL = f"""
journey AS (
  WITH j AS (
    SELECT event_id, user_id, event_type, ts, value,
           lead(event_type) OVER w AS next_state, lead(ts) OVER w AS next_ts
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id AS id, user_id, event_type AS state, next_state,
         (epoch_us(coalesce(next_ts, TIMESTAMP '{JOURNEY_END}')) - epoch_us(ts)) / 3.6e9 AS t,
         CAST(next_ts IS NOT NULL AS INTEGER) AS e, value
  FROM j)"""


def first_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    per_user = ev.groupBy("user_id").agg(
        F.min("ts").alias("t0"),
        F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("tp"))
    hours = (F.unix_micros(F.col("tp").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 3.6e9
    # users who never purchase are censored at the horizon
    h = per_user.withColumn("h", hours)
    return h.select(
        F.col("user_id").alias("id"),
        F.least(F.col("h"), F.lit(PURCHASE_HORIZON_H)).alias("t"),
        F.coalesce(F.col("h") <= PURCHASE_HORIZON_H, F.lit(False)).cast("int").alias("e"))


FIRST_PURCHASE_SQL = f"""
first_purchase AS (
  WITH u AS (
    SELECT user_id, min(ts) AS t0, min(CASE WHEN event_type = 'purchase' THEN ts END) AS tp
    FROM events GROUP BY user_id),
  h AS (SELECT user_id, (epoch_us(tp) - epoch_us(t0)) / 3.6e9 AS h FROM u)
  SELECT user_id AS id, CAST(least(coalesce(h, {PURCHASE_HORIZON_H}), {PURCHASE_HORIZON_H}) AS DOUBLE) AS t,
         CAST(coalesce(h <= {PURCHASE_HORIZON_H}, false) AS INTEGER) AS e
  FROM h)"""


def reused(df: DataFrame, *cols: str) -> DataFrame:
    """Project to the columns a query reuses and persist them once (a fixture read by several
    aggregates of one query); single-use queries stay unpersisted so the scan keeps its pruning."""
    from pyspark import StorageLevel
    return (df.select(*cols) if cols else df).persist(StorageLevel.MEMORY_AND_DISK)


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reorder(spark, sf_dir)
    return r.select(
        "id", "cluster", "seg",
        F.when(F.col("id") % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("price")).alias("price"),
        F.when(F.col("id") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("prio")).alias("prio"),
        "t",
        F.when(F.col("e") == 1, "Yes").otherwise("No").alias("status"),
        F.lit(1.0).alias("const_col"),
        F.col("price").alias("price_copy"),
        "cause",
    )


DIRTY_SQL = REORDER_SQL + """,
dirty AS (
  SELECT id, cluster, seg,
         CASE WHEN id % 17 = 0 THEN NULL ELSE price END AS price,
         CASE WHEN id % 13 = 0 THEN NULL ELSE prio END AS prio,
         t, CASE WHEN e = 1 THEN 'Yes' ELSE 'No' END AS status,
         1.0 AS const_col, price AS price_copy, cause
  FROM reorder)"""


def with_ctes(*ctes: str) -> str:
    """Join CTE bodies into one ``WITH`` prefix (deduplicating repeated ones)."""
    seen: list[str] = []
    for c in ctes:
        for part in _split(c):
            if part not in seen:
                seen.append(part)
    return "WITH " + ",".join(seen) + "\n"


def _split(cte: str) -> list[str]:
    if cte is DIRTY_SQL:
        return [REORDER_SQL, DIRTY_SQL[len(REORDER_SQL) + 1:]]
    return [cte]
