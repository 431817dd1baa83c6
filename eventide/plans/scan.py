"""Cumulative sums and products over an ordered column, safe at any size.

A window with few (or no) partition keys runs each partition in one task.
Time tables are usually small (one row per distinct time), but continuous
times at scale can produce a very large time table.  ``cumulative`` keeps the
simple single window when the table is provably small and otherwise switches
to a two-level scan:

1. cut the ordered column into quantile buckets (``approxQuantile`` on the
   distributed table, only the bucket bounds reach the driver);
2. cumulate inside each (partition, bucket) with a window — every window
   partition now holds about rows / buckets rows;
3. cumulate the tiny per-bucket totals and join them back as offsets.

Sums combine by addition and products by multiplication (so a survival
product that reaches 0 stays 0, unlike exp(sum(log))).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A time table at or under this many rows is scanned with one window per
# partition key.  Above it the two-level scan bounds every window task.
SINGLE_WINDOW_MAX_ROWS = 2_000_000
# Rows each bucket should hold in the two-level scan.
ROWS_PER_BUCKET = 500_000
# Offset tables up to this many rows are broadcast (checked by count).
BROADCAST_MAX_ROWS = 1_000_000


def cumulative(df: DataFrame, order_col: str, partition_by: Sequence[str] = (),
               sums: dict[str, str] | None = None,
               products: dict[str, str] | None = None,
               descending: bool = False,
               force_two_level: bool | None = None,
               n_buckets: int | None = None,
               exclusive: bool = False) -> DataFrame:
    """Append inclusive running sums/products of columns ordered by ``order_col``.

    ``df`` must have at most one row per (partition_by, order_col) value —
    aggregate to a time table first.  ``sums``/``products`` map output name to
    input column.  ``descending=True`` accumulates from the largest value down
    (the at-risk count is the descending running sum of subjects per time).
    ``exclusive=True`` leaves the current row out (S(t-) = product before t);
    an empty sum is 0 and an empty product 1.
    """
    sums = dict(sums or {})
    products = dict(products or {})
    part = list(partition_by)
    if force_two_level is None:
        rows = df.count()
        two_level = rows > SINGLE_WINDOW_MAX_ROWS
        if n_buckets is None:
            n_buckets = max(2, math.ceil(rows / ROWS_PER_BUCKET))
    else:
        two_level = force_two_level
        n_buckets = n_buckets or 8
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    end = -1 if exclusive else Window.currentRow
    if not two_level:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
        out = df
        for name, src in sums.items():
            out = out.withColumn(name, F.coalesce(F.sum(src).over(w), F.lit(0)))
        for name, src in products.items():
            out = out.withColumn(name, F.coalesce(F.product(src).over(w), F.lit(1.0)))
        return out
    return _two_level(df, order_col, part, sums, products, descending, n_buckets, end)


def _bucketize(df: DataFrame, order_col: str, n_buckets: int) -> DataFrame:
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.approxQuantile(order_col, probs, 1.0 / (4 * n_buckets))
    bounds = sorted(set(float(c) for c in cuts if c is not None and not math.isnan(c)))
    splits = [-math.inf] + bounds + [math.inf]
    tmp = "_eventide_order_d"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol="_bucket", handleInvalid="keep")
    out = b.transform(df.withColumn(tmp, F.col(order_col).cast("double"))).drop(tmp)
    return out.withColumn("_bucket", F.col("_bucket").cast("int"))


def _two_level(df, order_col, part, sums, products, descending, n_buckets, end):
    bdf = _bucketize(df, order_col, n_buckets)
    border = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    keys = part + ["_bucket"]
    # per-bucket totals: tiny (partitions x buckets rows)
    aggs = [F.sum(src).alias(f"_tot_{name}") for name, src in sums.items()]
    aggs += [F.product(src).alias(f"_tot_{name}") for name, src in products.items()]
    totals = bdf.groupBy(*keys).agg(*aggs)
    wb = Window.partitionBy(*part).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_tot_{n}").over(wb), F.lit(0)).alias(f"_off_{n}") for n in sums],
        *[F.coalesce(F.product(f"_tot_{n}").over(wb), F.lit(1.0)).alias(f"_off_{n}")
          for n in products],
    )
    n_offs = offs.count()
    if n_offs <= BROADCAST_MAX_ROWS:
        offs = F.broadcast(offs)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    local = bdf
    for name, src in sums.items():
        local = local.withColumn(f"_loc_{name}", F.coalesce(F.sum(src).over(w), F.lit(0)))
    for name, src in products.items():
        local = local.withColumn(f"_loc_{name}", F.coalesce(F.product(src).over(w), F.lit(1.0)))
    out = local.join(offs, on=keys, how="inner")
    for name in sums:
        out = out.withColumn(name, F.col(f"_off_{name}") + F.col(f"_loc_{name}"))
    for name in products:
        out = out.withColumn(name, F.col(f"_off_{name}") * F.col(f"_loc_{name}"))
    drop = ["_bucket"] + [f"_{k}_{n}" for k in ("off", "loc") for n in list(sums) + list(products)]
    return out.drop(*drop)


# A key with at most this many rows is led with a plain per-key window (bounded task);
# any larger key switches the whole lead to the split form below.
LEAD_WINDOW_MAX_KEY_ROWS = 2_000_000


def split_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               suffix: str = "_next", n_parts: int | None = None, force_split: bool | None = None) -> DataFrame:
    """``lead(col) over (partition by keys order by order)`` without putting a key in one task.

    Rows are range-partitioned on (keys, order), so a key holding a third of the
    rows spans many partitions.  The lead is taken inside each (partition, key)
    and the last row of a partition takes its successor from the first row of
    the next partition (a table with one row per partition, broadcast).
    ``order`` must make rows unique within a key.  The partitioned rows are
    persisted so both uses read one partitioning.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    if force_split is None:
        biggest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        force_split = biggest > LEAD_WINDOW_MAX_KEY_ROWS
    if not force_split:
        w0 = Window.partitionBy(*keys).orderBy(*order)
        out = df
        for c in cols:
            out = out.withColumn(c + suffix, F.lead(c).over(w0))
        return out
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from pyspark import StorageLevel
    # one cached plan = one RDD with one range partitioner: both branches below see the same
    # partition ids, and a lost cached partition is recomputed with the same bounds
    r = df.repartitionByRange(n_parts, *keys, *order).withColumn("_pid", F.spark_partition_id()) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    for c in cols:
        r = r.withColumn(c + suffix, F.lead(c).over(w))
    r = r.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    firsts = r.groupBy("_pid").agg(F.min_by(F.struct(*[F.col(k).alias(f"_fk{i}") for i, k in enumerate(keys)],
                                                     *[F.col(c).alias(f"_fv{i}") for i, c in enumerate(cols)]),
                                            F.struct(*keys, *order)).alias("_f"))
    # first row of the next non-empty partition (partitions can be empty): tiny window over partitions
    firsts = firsts.select(F.lag("_pid").over(Window.orderBy("_pid")).alias("_pid"), "_f") \
        .where(F.col("_pid").isNotNull())
    j = r.join(F.broadcast(firsts), "_pid", "left")  # one row per partition
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(f"_f._fk{i}") == F.col(k))
    for i, c in enumerate(cols):
        j = j.withColumn(c + suffix, F.when(F.col("_last") & F.coalesce(same, F.lit(False)), F.col(f"_f._fv{i}"))
                         .otherwise(F.col(c + suffix)))
    return j.drop("_pid", "_last", "_f")


# Working tables of iterative fits are cached and re-read every step; keep about this many rows
# per partition (tiny partitions cost a task each, a Python worker each for pandas steps).
ROWS_PER_PARTITION = 1_000_000


def right_size(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Coalesce (no shuffle) to max(default parallelism, rows / ROWS_PER_PARTITION) partitions
    when the table has more partitions than that."""
    n_rows = df.count() if n_rows is None else n_rows
    target = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / ROWS_PER_PARTITION))
    return df.coalesce(target) if df.rdd.getNumPartitions() > target else df
