"""Log-rank tests (two- and k-sample).

The k-sample test works on counts per (time, group).  Time is cut into buckets of about ``COUNTS`` such
rows; a small table (bucket, group) carries how many of each group are at risk after a bucket.  One
task takes a bucket, runs the at-risk counts down in time and sums observed, expected and the covariance
    sum_t v(t) (diag(p(t)) - p(t) p(t)'),  v = d (n - d) / (n - 1),  p_i = n_i / n
as NumPy products over bounded chunks of times.  The covariance leaves it in blocks of ``BLOCK`` groups,
which Spark adds up; the k x k matrix is solved on the driver.  There is no limit on the groups but
that matrix (5000 groups: 200 MB).

The two-sample table and multi-state counts pivot their few groups into columns (``MAX_GROUPS``, checked).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.stats import chi2_sf
from eventide.plans.scan import cumulative

#: Groups, causes or states that are pivoted into columns.
MAX_GROUPS = 64


def group_values(df: DataFrame, group: str, limit: int = MAX_GROUPS) -> list:
    vals = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct()
            .limit(limit + 1).collect()]
    if len(vals) > limit:
        raise ValueError(f"{group!r} has more than {limit} groups")
    return sorted(vals)


def pooled_time_table(df: DataFrame, group: str, time: str = "t", event: str = "e",
                      values: list | None = None) -> tuple[DataFrame, list]:
    """time, d, n, and per group i: d_i, n_i (pivoted)."""
    vals = values if values is not None else group_values(df, group)
    g = F.col(group)
    ev = F.col(event).cast("long")
    aggs = [F.sum(ev).alias("d"), F.count(F.lit(1)).alias("m")]
    for i, v in enumerate(vals):
        aggs += [F.sum(F.when(g == F.lit(v), ev).otherwise(0)).alias(f"d_{i}"),
                 F.sum(F.when(g == F.lit(v), 1).otherwise(0)).alias(f"m_{i}")]
    tt = df.where(g.isNotNull()).groupBy(F.col(time).cast("double").alias("time")).agg(*aggs)
    sums = {"n": "m", **{f"n_{i}": f"m_{i}" for i in range(len(vals))}}
    return cumulative(tt, "time", [], sums=sums, descending=True), vals


def observed_expected(df: DataFrame, group: str, time: str = "t", event: str = "e",
                      values: list | None = None) -> tuple[DataFrame, list]:
    """Per-time expected events and variance terms; returns (table, group values)."""
    tt, vals = pooled_time_table(df, group, time, event, values)
    n = F.col("n").cast("double")
    d = F.col("d").cast("double")
    vf = F.when(n > 1, d * (n - d) / (n - 1.0)).otherwise(0.0)
    cols = [F.col("time"), d.alias("d"), n.alias("n"), vf.alias("vf")]
    for i in range(len(vals)):
        cols += [F.col(f"d_{i}").cast("double").alias(f"o_{i}"),
                 (d * F.col(f"n_{i}") / n).alias(f"e_{i}"),
                 (F.col(f"n_{i}") / n).alias(f"p_{i}")]
    return tt.select(*cols), vals


#: (time, group) counts of one bucket, numbers of one matrix in a task, and groups of one block of the covariance.
COUNTS = 200_000
CELLS = 4_000_000
BLOCK = 64


def _group_sums(df: DataFrame, group: str, time: str, event: str, covariance: bool, counts_each: int):
    """(group values in order, observed, expected, covariance or None) over all rows with a group and a time."""
    from eventide.operators.additive import _time_buckets
    from eventide.operators.relational import maybe_broadcast
    x = df.select(F.col(group).alias("g"), F.col(time).cast("double").alias("time"), F.col(event).cast("long").alias("e"))
    x = x.where("g IS NOT NULL AND time IS NOT NULL")
    counts = x.groupBy("g", "time").agg(F.sum("e").alias("d"), F.count(F.lit(1)).alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    vals = sorted(r["g"] for r in counts.select("g").distinct().collect())  # k values: k x k numbers follow
    k = len(vals)
    if k == 0:
        return [], np.zeros(0), np.zeros(0), np.zeros((0, 0))
    names = df.sparkSession.createDataFrame(list(zip(vals, range(k), strict=True)),
                                            T.StructType([T.StructField("g", counts.schema["g"].dataType), T.StructField("gi", T.IntegerType())]))
    dealt, n_buckets = _time_buckets(counts.join(maybe_broadcast(names), "g").select("gi", "time", "d", "m"), counts_each)
    sums = dealt.groupBy("_bucket", "gi").agg(F.sum("m").alias("m"))
    grid = (dealt.select("_bucket").distinct().select("_bucket", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("gi"))
            .join(sums, ["_bucket", "gi"], "left"))
    later = Window.partitionBy("gi").orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select(F.col("_bucket").alias("_at"), "gi", F.coalesce(F.sum("m").over(later), F.lit(0)).alias("after"))
    width = -(-k // BLOCK)

    def bucket(left, right):
        at_risk = np.zeros(k)
        at_risk[right["gi"].to_numpy()] = right["after"].to_numpy(float)
        at, row = np.unique(-left["time"].to_numpy(float), return_inverse=True)  # latest first
        gi, d, m = left["gi"].to_numpy(), left["d"].fillna(0).to_numpy(float), left["m"].to_numpy(float)
        order = np.argsort(row, kind="stable")
        row, gi, d, m = row[order], gi[order], d[order], m[order]
        observed, expected, diagonal = np.bincount(gi, d, k), np.zeros(k), np.zeros(k)
        cross = np.zeros((k, k)) if covariance else None
        each = max(1, CELLS // k)
        for a in range(0, len(at), each):
            here = slice(*np.searchsorted(row, [a, a + each]))
            size = min(each, len(at) - a)
            n = np.zeros((size, k))
            n[row[here] - a, gi[here]] = m[here]
            n = at_risk + np.cumsum(n, axis=0)
            at_risk = n[-1]
            died = np.bincount(row[here] - a, d[here], size)
            n, died = n[died > 0], died[died > 0]
            total = n.sum(axis=1)
            expected += (died / total) @ n
            if covariance:
                v = np.divide(died * (total - died), total - 1, out=np.zeros(len(total)), where=total > 1)
                p = n / total[:, None]
                diagonal += v @ p
                cross += (p * v[:, None]).T @ p
        rows = [(-1, np.concatenate([observed, expected]))]
        if covariance:
            cov = np.diag(diagonal) - cross
            rows += [(i, cov[i * BLOCK:(i + 1) * BLOCK].ravel()) for i in range(width)]
        return pd.DataFrame({"block": [r[0] for r in rows], "part": int(left["_bucket"].iloc[0]) % 32, "v": [r[1] for r in rows]})

    def add(pdf):
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    schema = "block int, part int, v array<double>"
    got = dealt.groupBy("_bucket").cogroup(grid.groupBy("_at")).applyInPandas(bucket, schema)
    if n_buckets > 1:
        got = got.groupBy("block", "part").applyInPandas(add, schema)
    total = {}
    for r in got.collect():  # at most 32 times k x k numbers
        total[r["block"]] = total.get(r["block"], 0.0) + np.array(r["v"])
    counts.unpersist()
    cov = np.concatenate([total[i].reshape(-1, k) for i in range(width)]) if covariance else None
    return vals, total[-1][:k], total[-1][k:], cov


def logrank_table(df: DataFrame, group: str, time: str = "t", event: str = "e", counts_each: int = COUNTS) -> DataFrame:
    """K07/K08 per-group table: group (as text), observed, expected (long, one row per group)."""
    vals, o, e, _ = _group_sums(df, group, time, event, False, counts_each)
    rows = [(str(v), float(a), float(b)) for v, a, b in zip(vals, o, e, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"`{group}` string, observed double, expected double")


def logrank(df: DataFrame, group: str, time: str = "t", event: str = "e", counts_each: int = COUNTS) -> dict:
    """K-sample log-rank statistic, degrees of freedom and p-value.

    Returns a small dict (statistic, df, p_value, groups, observed, expected) — the
    result of a (k x k) solve on the driver.
    """
    vals, o, e, cov = _group_sums(df, group, time, event, True, counts_each)
    k = len(vals)
    if k < 2:
        return {"statistic": 0.0, "df": 0, "p_value": 1.0, "groups": vals}
    diff, V = (o - e)[:k - 1], cov[:k - 1, :k - 1]
    stat = float(diff @ np.linalg.pinv((V + V.T) / 2, hermitian=True) @ diff)
    return {"statistic": stat, "df": k - 1, "p_value": chi2_sf(stat, k - 1), "groups": vals,
            "observed": o.tolist(), "expected": e.tolist()}


def logrank_two_sample(df: DataFrame, group: str, time: str = "t", event: str = "e") -> DataFrame:
    """K07 as a one-row table: observed, expected, variance (of the first group), statistic."""
    oe, vals = observed_expected(df, group, time, event)
    if len(vals) != 2:
        raise ValueError("two-sample log-rank needs exactly two groups")
    var = F.col("vf") * F.col("p_0") * (1.0 - F.col("p_0"))
    agg = oe.agg(F.sum("o_0").alias("observed"), F.sum("e_0").alias("expected"),
                 F.sum(var).alias("variance"))
    return agg.withColumn("statistic", F.pow(F.col("observed") - F.col("expected"), 2)
                          / F.col("variance"))
