"""Exact concordance equals brute force for any bucketing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.operators.concordance import concordance, concordance_by


def brute(t, e, r):
    c = d = ti = 0
    for i in range(len(t)):
        if e[i] != 1:
            continue
        for j in range(len(t)):
            if t[i] < t[j] or (t[i] == t[j] and e[j] == 0):
                if r[i] > r[j]:
                    c += 1
                elif r[i] < r[j]:
                    d += 1
                else:
                    ti += 1
    return c, d, ti


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("nb", [1, 3, 8])
def test_concordance_exact(spark, seed, nb):
    rng = np.random.default_rng(seed)
    n = 300
    t = rng.integers(1, 25, n).astype(float)
    e = rng.integers(0, 2, n)
    r = rng.integers(0, 12, n).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)],
                               "t double, e int, risk double")
    res = concordance(df, n_buckets=nb)
    assert (res["concordant"], res["discordant"], res["tied_risk"]) == brute(t, e, r)


def test_negated_risk(spark):
    rng = np.random.default_rng(3)
    n = 250
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in
                                zip(rng.exponential(size=n), rng.integers(0, 2, n), rng.normal(size=n))],
                               "t double, e int, risk double")
    a = concordance(df)["c_index"]
    b = concordance(df.withColumn("risk", -F.col("risk")))["c_index"]
    assert abs(a + b - 1.0) < 1e-12


def test_grouped_equals_separate(spark):
    rng = np.random.default_rng(5)
    n = 300
    rows = [(int(g), float(a), int(b), float(c)) for g, a, b, c in
            zip(rng.integers(0, 3, n), rng.integers(1, 10, n), rng.integers(0, 2, n), rng.integers(0, 5, n))]
    df = spark.createDataFrame(rows, "g int, t double, e int, risk double")
    by = {r["g"]: r["c_index"] for r in concordance_by(df, ["g"]).collect()}
    for g in range(3):
        assert abs(by[g] - concordance(df.where(F.col("g") == g))["c_index"]) < 1e-12


def test_cross_bucket_spark_path_equals_driver(spark):
    from eventide.operators import concordance as C
    rng = np.random.default_rng(0)
    n = 1500
    df = spark.createDataFrame([(int(g), float(a), int(b), float(c)) for g, a, b, c in
                                zip(rng.integers(0, 3, n), rng.integers(1, 50, n), rng.integers(0, 2, n),
                                    rng.normal(size=n))], "g int, t double, e int, risk double")
    a = {r["g"]: (r["concordant"], r["discordant"]) for r in C.concordance_by(df, ["g"], n_buckets=6).collect()}
    old = C.DRIVER_CELLS
    C.DRIVER_CELLS = 0
    try:
        b = {r["g"]: (r["concordant"], r["discordant"]) for r in C.concordance_by(df, ["g"], n_buckets=6).collect()}
    finally:
        C.DRIVER_CELLS = old
    assert a == b


def test_heavy_time_value_exact(spark):
    """A third of the rows share one time (skew): still exact for any bucketing."""
    rng = np.random.default_rng(9)
    n = 450
    t = np.where(rng.random(n) < 1 / 3, 5.0, rng.integers(1, 30, n).astype(float))
    e = rng.integers(0, 2, n)
    r = rng.normal(size=n).round(2)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)],
                               "t double, e int, risk double")
    for nb in (2, 5, 9):
        res = concordance(df, n_buckets=nb)
        assert (res["concordant"], res["discordant"], res["tied_risk"]) == brute(t, e, r)


def test_heavy_risk_value_is_summed_before_its_group(spark):
    """Half the rows share one risk: no pandas group sees more than the bound, and counts stay exact."""
    import numpy as np

    from eventide.operators import concordance as C
    rng = np.random.default_rng(11)
    n = 3000
    risk = np.where(rng.random(n) < 0.5, 1.0, rng.normal(size=n))
    t, e = rng.exponential(100, n), (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, risk, strict=True)], "t double, e int, risk double")
    one = C.concordance(df, n_buckets=1)
    many = C.concordance(df, n_buckets=12)
    assert {k: round(v, 9) for k, v in one.items()} == {k: round(v, 9) for k, v in many.items()}
    g = df.groupBy(F.col("t").alias("time"), F.col("e").alias("event"), "risk").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ks, rs = C._splits2(g, ["time", "risk"], 12)
    gb = C._bucket(C._bucket(g, "time", "kb", ks), "risk", "rb", rs)
    per = gb.groupBy("rb", "kb", "risk", "event").count().groupBy("rb").count().agg(F.max("count")).first()[0]
    assert per <= n // 6


def test_many_buckets_of_few_rows_exact(spark, monkeypatch):
    """Groups of about 100 rows and blocks of buckets: no cap, the same counts; a tied third and weights too."""
    from eventide.operators import concordance as C
    rng = np.random.default_rng(11)
    n = 3000
    t = np.where(rng.random(n) < 0.3, 50, rng.integers(1, 900, n)).astype(float)
    e, r = rng.integers(0, 2, n), np.where(rng.random(n) < 0.3, 7, rng.integers(0, 700, n)).astype(float)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)], "t double, e int, risk double")
    want = concordance(df, n_buckets=1)
    monkeypatch.setattr(C, "ROWS_PER_GROUP", 100)
    monkeypatch.setattr(C, "DRIVER_CELLS", 25)  # 5 x 5 blocks
    seen = []
    original = C._cross_tree
    monkeypatch.setattr(C, "_cross_tree", lambda cells, by, nk, nr, side: seen.append((nk, side)) or original(cells, by, nk, nr, side))
    got = concordance(df)
    assert seen and seen[0][0] > 25 and seen[0][1] == 5
    assert {k: got[k] for k in want} == pytest.approx(want)


@pytest.mark.parametrize("n_buckets", [1, 4, 9])
def test_replicate_counts_equal_weighted_concordance(spark, n_buckets):
    """All replicates in one pass equal a weighted concordance of each, heavy times and risks and their cell too."""
    from eventide.operators.concordance import replicate_counts
    rng = np.random.default_rng(4)
    n, n_boot = 600, 5
    t = np.where(rng.random(n) < 0.5, 20.0, rng.integers(1, 60, n)).astype(float)
    e, r = rng.integers(0, 2, n), np.where(rng.random(n) < 0.5, 3.0, rng.normal(size=n).round(1))
    w = rng.integers(0, 4, (n, n_boot)).astype(np.uint8)
    df = spark.createDataFrame([(i, float(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(t, e, r))], "id long, t double, e int, risk double")
    got = {x["rep"]: x for x in replicate_counts(df, n_boot, lambda ids: w[[int(i) for i in ids]], n_buckets=n_buckets)}
    assert sorted(got) == list(range(n_boot))
    for k in range(n_boot):
        weighted = df.withColumn("w", F.element_at(F.lit([int(v) for v in w[:, k]]), F.col("id").cast("int") + 1))
        want = concordance(weighted, weight="w", n_buckets=1)
        assert (got[k]["conc"], got[k]["disc"], got[k]["tied"]) == (want["concordant"], want["discordant"], want["tied_risk"])
        assert got[k]["weight"] == w[:, k].sum()


def test_groups_grow_with_buckets_not_cells(spark, monkeypatch):
    """One group per risk bucket and per time bucket: with a group per cell there were buckets squared."""
    from eventide.operators import concordance as C
    rng = np.random.default_rng(6)
    n = 900
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(rng.random(n), rng.integers(0, 2, n), rng.normal(size=n))],
                               "t double, e int, risk double")
    want = concordance(df, n_buckets=1)
    groups = spark.sparkContext.accumulator(0)
    original = C._group_counts

    def counted(pdf, by_key_rank):
        groups.add(1)
        return original(pdf, by_key_rank)
    monkeypatch.setattr(C, "_group_counts", counted)
    got = concordance(df, n_buckets=10)
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert groups.value <= 4 * 10


def test_missing_times_and_risks_in_many_buckets(spark):
    """Missing values stopped the bucketed count (index out of bounds); now as in one bucket."""
    rows = [(float(i % 37), i % 2, float(i * 7 % 41)) for i in range(400)] + [(None, 1, 3.0), (12.0, 1, None)]
    df = spark.createDataFrame(rows, "t double, e int, risk double")
    one, many = concordance(df, n_buckets=1), concordance(df, n_buckets=5)
    assert {k: many[k] for k in one} == pytest.approx(one)
