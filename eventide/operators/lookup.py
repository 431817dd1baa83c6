"""As-of (step) and interpolating lookups of curves at arbitrary times.

Spark has no as-of join.  ``step_lookup`` unions curve rows and query points
and carries the last curve value forward with ``last(..., ignorenulls)``.  To
keep every window task bounded the time axis is cut into quantile buckets of
the curve; a point whose bucket has no earlier curve row takes the carry-over
value of the previous buckets from a tiny per-bucket table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CURVE_ROWS_PER_BUCKET = 500_000


def _buckets(curve: DataFrame, time: str, n: int) -> list[float]:
    if n <= 1:
        return [-math.inf, math.inf]
    cuts = curve.approxQuantile(time, [i / n for i in range(1, n)], 1.0 / (4 * n))
    return [-math.inf] + sorted(set(float(c) for c in cuts)) + [math.inf]


def _with_bucket(df: DataFrame, time: str, splits: list[float]) -> DataFrame:
    if len(splits) <= 2:
        return df.withColumn("_bucket", F.lit(0))
    tmp = "_lk_time_d"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol="_bucket", handleInvalid="keep")
    return (b.transform(df.withColumn(tmp, F.col(time).cast("double"))).drop(tmp)
            .withColumn("_bucket", F.col("_bucket").cast("int")))


def step_lookup(curves: DataFrame, points: DataFrame, keys: Sequence[str], time: str,
                value_cols: Sequence[str], defaults: dict | None = None,
                n_buckets: int | None = None) -> DataFrame:
    """Right-continuous value of each curve at each point.

    ``curves`` has one row per (keys, time); ``points`` any rows with ``keys``
    and ``time`` (other columns are kept).  Before the first curve time the
    value is ``defaults[col]`` (None unless given); after the last it is the
    last value.

    Only the distinct (keys, time) of the points are looked up — a heavy point
    value collapses to one row — with buckets cut on the union of curve and point
    times, so every window task holds a bounded number of rows.  The answers are
    joined back to the points (broadcast when their count allows).
    """
    from eventide.operators.relational import maybe_broadcast
    keys = list(keys)
    vals = list(value_cols)
    defaults = defaults or {}
    pd_ = points.select(*keys, time).distinct()
    if n_buckets is None:
        n_rows = curves.count() + pd_.count()
        n_buckets = max(1, math.ceil(n_rows / CURVE_ROWS_PER_BUCKET))
    both = curves.select(F.col(time).cast("double").alias("_q")).unionByName(
        pd_.select(F.col(time).cast("double").alias("_q")))
    splits = _buckets(both, "_q", n_buckets)
    cu = _with_bucket(curves.select(*keys, time, *vals), time, splits)
    pt = _with_bucket(pd_, time, splits)
    cur_struct = F.struct(*[F.col(v).alias(v) for v in vals])
    cu_rows = cu.select(*keys, "_bucket", time, F.lit(0).alias("_tag"), cur_struct.alias("_cv"))
    pt_rows = pt.select(*keys, "_bucket", time, F.lit(1).alias("_tag"),
                        F.lit(None).cast(cu_rows.schema["_cv"].dataType).alias("_cv"))
    w = (Window.partitionBy(*keys, "_bucket").orderBy(F.col(time), F.col("_tag"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = cu_rows.unionByName(pt_rows).withColumn("_loc", F.last("_cv", ignorenulls=True).over(w))
    hit = u.where(F.col("_tag") == 1).drop("_cv")
    if len(splits) > 2:
        # carry: last curve value of all earlier buckets (tiny table: keys x buckets)
        last_in_bucket = cu.groupBy(*keys, "_bucket").agg(
            F.max_by(cur_struct, F.col(time)).alias("_lb"))
        nb = len(splits) - 1
        grid = cu.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))
                                                  .alias("_bucket"))
        wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = (grid.join(last_in_bucket, on=keys + ["_bucket"], how="left")
                 .select(*keys, "_bucket", F.last("_lb", ignorenulls=True).over(wb).alias("_carry")))
        hit = hit.join(carry, on=keys + ["_bucket"], how="left")
        val = F.coalesce(F.col("_loc"), F.col("_carry"))
    else:
        val = F.col("_loc")
    cols = [F.coalesce(val[v], F.lit(defaults.get(v))).alias(v) if v in defaults else val[v].alias(v)
            for v in vals]
    answers = hit.select(*keys, time, *cols)
    return points.join(maybe_broadcast(answers), on=[*keys, time], how="left")


def linear_lookup(curves: DataFrame, points: DataFrame, keys: Sequence[str], time: str,
                  value_col: str, point_id: str) -> DataFrame:
    """Linear interpolation between neighbouring curve points, clamped at the ends.

    ``point_id`` must identify a point row (with ``keys``) so both sides of the
    interpolation can be put together by a join.
    """
    keys = list(keys)
    c = curves.select(*keys, time, value_col)
    p = points.withColumn("_pid", F.col(point_id))
    prev = step_lookup(c.withColumn("_pt", F.col(time)).withColumnRenamed(value_col, "_pv"),
                       p, keys, time, ["_pv", "_pt"])
    neg = (c.withColumn("_nt", F.col(time)).withColumnRenamed(value_col, "_nv")
           .withColumn(time, -F.col(time)))
    nxt = step_lookup(neg, p.select(*keys, time, "_pid").withColumn(time, -F.col(time)),
                      keys, time, ["_nv", "_nt"]).drop(time)
    j = prev.join(nxt, on=keys + ["_pid"], how="inner")
    t = F.col(time)
    frac = F.try_divide(t - F.col("_pt"), F.col("_nt") - F.col("_pt"))
    v = (F.when(F.col("_pv").isNull(), F.col("_nv"))
         .when(F.col("_nv").isNull() | (F.col("_nt") == F.col("_pt")), F.col("_pv"))
         .otherwise(F.col("_pv") + frac * (F.col("_nv") - F.col("_pv"))))
    return j.withColumn(value_col, v).drop("_pv", "_pt", "_nv", "_nt", "_pid")
