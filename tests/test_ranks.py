"""Two-level rank primitives equal a global row_number; permutations keep the multiset."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.functions.exprs import hash_int
from eventide.operators.split import sorted_dense_rank, uniform_rank


def test_uniform_rank_equals_global(spark):
    df = spark.range(5000).withColumn("k", hash_int(7, F.col("id")))
    a = {r["id"]: r["rank"] for r in uniform_rank(df, "k", "id", n_buckets=13).collect()}
    b = {r["id"]: r["rk"] for r in df.withColumn("rk", F.row_number().over(Window.orderBy("k", "id"))).collect()}
    assert a == b


def test_sorted_dense_rank(spark):
    vals = [f"v{i:05d}" for i in np.random.default_rng(0).permutation(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = {r["s"]: r["rank"] for r in sorted_dense_rank(df, "s", n_parts=7).collect()}
    assert got == {v: i + 1 for i, v in enumerate(sorted(vals))}


def test_permutation_keeps_values(spark):
    from eventide.operators.factory import make_model
    from eventide.operators.train import permutation_importance
    rng = np.random.default_rng(1)
    n = 400
    df = spark.createDataFrame([(i, float(rng.exponential(10)), int(rng.integers(0, 2)), float(rng.normal()))
                                for i in range(n)], "id int, t double, e int, x double")
    est = make_model("cox_ph").fit(df, "t", "e", ["x"])
    imp = permutation_importance(est, df, ["x"], "id").collect()
    assert len(imp) == 1 and imp[0]["importance"] > 0
    # the donor join is a bijection on ranks: shuffled column has the same multiset
    ranked = uniform_rank(df.withColumn("_k0", hash_int(42, F.col("id"))), "_k0", "id")
    donor = uniform_rank(df.withColumn("_k1", hash_int("42:x", F.col("id"))), "_k1", "id") \
        .select(F.col("rank"), F.col("x").alias("xp"))
    sh = ranked.join(donor, "rank")
    assert sh.count() == n
    assert sorted(r["xp"] for r in sh.collect()) == sorted(r["x"] for r in df.collect())


def test_validate_sample_keys(spark):
    from eventide.operators.validate import validate
    df = spark.createDataFrame([(i, None if i % 5 == 0 else float(i)) for i in range(1, 50)], "id int, v double")
    out = {r["column_name"]: r for r in validate(df, key="id", sample_size=3).collect()}
    assert out["v"]["affected_rows"] == 9
    assert out["v"]["sample_keys"] == ["5", "10", "15"]
