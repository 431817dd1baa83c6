"""Two-level running sums/products equal the single window; results do not depend on partitioning."""

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import risk
from eventide.plans import fixtures as fx
from eventide.plans.scan import cumulative
from tests.conftest import SF_MID


def _table(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(g), float(t), float(v), float(f)) for g, t, v, f in
            zip(rng.integers(0, 3, n), rng.permutation(n), rng.normal(size=n), rng.uniform(0.9, 1.0, n))]
    return spark.createDataFrame(rows, "g int, t double, v double, f double")


def test_two_level_equals_window(spark):
    df = _table(spark)
    for part in ([], ["g"]):
        for desc in (False, True):
            for excl in (False, True):
                a = cumulative(df, "t", part, {"s": "v"}, {"p": "f"}, desc, force_two_level=False,
                               exclusive=excl)
                b = cumulative(df, "t", part, {"s": "v"}, {"p": "f"}, desc, force_two_level=True,
                               n_buckets=7, exclusive=excl)
                ja = {(r["g"], r["t"]): (r["s"], r["p"]) for r in a.collect()}
                jb = {(r["g"], r["t"]): (r["s"], r["p"]) for r in b.collect()}
                assert ja.keys() == jb.keys()
                for k in ja:
                    assert abs(ja[k][0] - jb[k][0]) < 1e-9
                    assert abs(ja[k][1] - jb[k][1]) <= 1e-12 + 1e-9 * abs(ja[k][1])


def test_km_two_level_equals_single(spark):
    df = fx.reorder(spark, SF_MID)
    a = risk.kaplan_meier(df, strata="seg", force_two_level=False).collect()
    b = risk.kaplan_meier(df, strata="seg", force_two_level=True).collect()
    ka = {(r["seg"], r["time"]): r for r in a}
    kb = {(r["seg"], r["time"]): r for r in b}
    assert ka.keys() == kb.keys()
    for k in ka:
        assert ka[k]["n_at_risk"] == kb[k]["n_at_risk"]
        assert abs(ka[k]["survival"] - kb[k]["survival"]) < 1e-12


def test_partition_count_does_not_matter(spark):
    df = fx.reorder(spark, SF_MID)
    a = risk.kaplan_meier(df.repartition(1), with_ci=False).orderBy("time").collect()
    b = risk.kaplan_meier(df.repartition(13, "id"), with_ci=False).orderBy("time").collect()
    assert [(r["time"], r["n_at_risk"], round(r["survival"], 12)) for r in a] == \
        [(r["time"], r["n_at_risk"], round(r["survival"], 12)) for r in b]


def test_step_lookup_buckets(spark):
    from eventide.operators.lookup import linear_lookup, step_lookup
    curve = spark.createDataFrame([(float(t), float(t) * 2) for t in range(0, 100, 3)], "time double, v double")
    pts = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-1.0, 0.0, 1.5, 3.0, 50.0, 98.0, 200.0])],
                                "pid int, time double")
    for nb in (1, 4):
        got = {r["pid"]: r["v"] for r in step_lookup(curve, pts, [], "time", ["v"], n_buckets=nb).collect()}
        assert got == {0: None, 1: 0.0, 2: 0.0, 3: 6.0, 4: 96.0, 5: 192.0, 6: 198.0}
    lin = {r["pid"]: r["v"] for r in linear_lookup(curve, pts, [], "time", "v", "pid").collect()}
    assert lin[2] == 3.0 and lin[0] == 0.0 and lin[6] == 198.0 and lin[4] == 100.0
    _ = F


def test_split_lead_equals_window(spark):
    from pyspark.sql import Window as W

    from eventide.plans.scan import split_lead
    rng = np.random.default_rng(2)
    # key 0 holds a third of the rows (skew); many partitions, some possibly empty
    keys = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(1, 200, 3000))
    df = spark.createDataFrame([(int(k), int(i), float(v)) for i, (k, v) in
                                enumerate(zip(keys, rng.normal(size=3000)))], "k int, o int, v double")
    for parts in (3, 17, 64):
        got = {r["o"]: r["v_next"] for r in split_lead(df, ["k"], ["o"], ["v"], n_parts=parts,
                                                       force_split=True).collect()}
        ref = {r["o"]: r["vn"] for r in df.withColumn("vn", F.lead("v").over(W.partitionBy("k").orderBy("o")))
               .collect()}
        assert got == ref


def test_shuffle_partitions_do_not_matter(spark):
    df = fx.reorder(spark, SF_MID)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            c = risk.kaplan_meier(df, strata="seg", with_ci=False).collect()
            res.append(sorted((r["seg"], r["time"], r["n_at_risk"], round(r["survival"], 12)) for r in c))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_two_level_plan_has_no_full_table_single_partition_window(spark):
    """Above the threshold every window over the time table is partitioned by bucket; the only
    unpartitioned window runs over the per-bucket totals."""
    df = _table(spark, n=4000)
    out = cumulative(df, "t", [], {"s": "v"}, force_two_level=True, n_buckets=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert any("], [_bucket" in w for w in windows)  # local windows partitioned by bucket
    # the unpartitioned window (offsets) sits on top of the totals aggregate, not on the rows
    assert "_tot_s" in plan
