"""Deterministic train/test splits and folds.

Every random choice is a function of md5(seed:id), so splits are identical
across runs, partitionings and engines and never depend on row order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import cut_lineage
from eventide.functions.exprs import hash_int, hash_unit

RANK_BUCKETS = 64
# rows per window task in the two-level ranks: buckets grow with the table
ROWS_PER_RANK_BUCKET = 1_000_000


def _rank_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    return max(RANK_BUCKETS, math.ceil(df.count() / ROWS_PER_RANK_BUCKET))


def random_split(df: DataFrame, id_col: str = "id", test: float = 0.2,
                 seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Test rows are those with hash key < ``test``."""
    u = hash_unit(seed, F.col(id_col))
    return df.where(u >= test), df.where(u < test)


def stratified_split(df: DataFrame, event: str = "e", id_col: str = "id", test: float = 0.25,
                     seed: int = 42, n_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """In each event class, the floor(test * n + 0.5) rows with the smallest keys go to test.

    The per-class rank is computed in two levels so no window holds a whole
    class: the key is uniform, so equal-width key buckets are balanced; rows
    are ranked inside (class, bucket) and shifted by the counts of earlier
    buckets (a tiny table).
    """
    n_buckets = _rank_buckets(df, n_buckets)
    k = df.withColumn("_key", hash_int(seed, F.col(id_col))).withColumn(
        "_b", F.floor(F.col("_key") / F.lit(4294967296.0 / n_buckets)).cast("int"))
    counts = k.groupBy(event, "_b").agg(F.count(F.lit(1)).alias("_c"))  # classes x buckets rows
    wb = Window.partitionBy(event).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(event)
    offs = counts.select(event, "_b", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"),
                         F.sum("_c").over(wall).alias("_n"))
    w = Window.partitionBy(event, "_b").orderBy("_key", id_col)
    ranked = (k.withColumn("_r", F.row_number().over(w))
              .join(F.broadcast(offs), on=[event, "_b"], how="inner"))
    is_test = (F.col("_off") + F.col("_r")) <= F.floor(F.col("_n") * F.lit(test) + 0.5)
    ranked = ranked.withColumn("_test", is_test)
    cols = df.columns
    return ranked.where(~F.col("_test")).select(*cols), ranked.where(F.col("_test")).select(*cols)


def kfold(df: DataFrame, k: int = 5, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Adds ``fold`` in [0, k) = hash key mod k."""
    return df.withColumn("fold", F.pmod(hash_int(seed, F.col(id_col)), F.lit(k)).cast("int"))


def uniform_rank(df: DataFrame, key: str, tie: str, n_buckets: int | None = None) -> DataFrame:
    """Row number (1..N) by a uniform integer key in [0, 2^32), ties by ``tie``.

    Two levels so no window holds the whole table: equal-width key buckets are
    balanced because the key is a hash; rows are numbered inside each bucket
    and shifted by the counts of earlier buckets (a tiny table).
    """
    n_buckets = _rank_buckets(df, n_buckets)
    k = df.withColumn("_b", F.floor(F.col(key) / F.lit(4294967296.0 / n_buckets)).cast("int"))
    counts = k.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # n_buckets rows
    offs = counts.select("_b", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_b").orderBy(key, tie)
    out = k.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offs), "_b")
    return out.withColumn("rank", F.col("_off") + F.col("_r")).drop("_b", "_r", "_off")


def sorted_dense_rank(distinct: DataFrame, col: str, n_parts: int | None = None) -> DataFrame:
    """Rank (1..N) of distinct values in sorted order without a global window.

    ``repartitionByRange`` puts contiguous value ranges in partitions; values are
    ranked inside each partition and shifted by the sizes of earlier partitions
    (a table with one row per partition).
    """
    n_parts = n_parts or distinct.sparkSession.sparkContext.defaultParallelism
    # written once: a second evaluation could draw other range bounds
    r = cut_lineage(distinct.repartitionByRange(n_parts, col).withColumn("_pid", F.spark_partition_id()))
    sizes = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = sizes.select("_pid", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(col)
    out = r.withColumn("_r", F.row_number().over(w)).join(F.broadcast(offs), "_pid")
    return out.select(col, (F.col("_off") + F.col("_r")).alias("rank"))
