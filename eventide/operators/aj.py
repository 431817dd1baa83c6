"""Aalen-Johansen estimator for competing risks.

State 0 = event-free with probability S(t) (all-cause Kaplan-Meier); state k
is reached with probability CIF_k(t) = sum_{u<=t} S(u-) d_k(u) / n(u).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.logrank import group_values
from eventide.plans.scan import cumulative


def aalen_johansen(df: DataFrame, time: str = "t", cause: str = "cause",
                   causes: list | None = None, force_two_level: bool | None = None) -> DataFrame:
    """Long table (time, state, probability); state 0 is S, state k the CIF of cause k."""
    ks = causes if causes is not None else [c for c in group_values(df, cause) if c != 0]
    c = F.col(cause)
    aggs = [F.sum(F.when(c != 0, 1).otherwise(0)).alias("d"), F.count(F.lit(1)).alias("m")]
    aggs += [F.sum(F.when(c == F.lit(k), 1).otherwise(0)).alias(f"d_{i}") for i, k in enumerate(ks)]
    tt = df.groupBy(F.col(time).cast("double").alias("time")).agg(*aggs)
    tt = cumulative(tt, "time", [], sums={"n": "m"}, descending=True,
                    force_two_level=force_two_level)
    tt = tt.withColumn("_f", 1.0 - F.col("d") / F.col("n"))
    tt = cumulative(tt, "time", [], products={"s_prev": "_f"}, exclusive=True,
                    force_two_level=force_two_level)
    tt = tt.withColumn("s", F.col("s_prev") * F.col("_f"))
    for i in range(len(ks)):
        tt = tt.withColumn(f"_inc_{i}", F.col("s_prev") * F.col(f"d_{i}") / F.col("n"))
    tt = cumulative(tt, "time", [], sums={f"cif_{i}": f"_inc_{i}" for i in range(len(ks))},
                    force_two_level=force_two_level)
    stack = ", ".join([f"0, s"] + [f"{int(k)}, cif_{i}" for i, k in enumerate(ks)])
    return tt.selectExpr("time", f"stack({len(ks) + 1}, {stack}) AS (state, probability)")


def aj_summary(curves: DataFrame) -> DataFrame:
    """Per state the final probability and number of times; median stay in state 0."""
    per = curves.groupBy("state").agg(
        F.max_by("probability", "time").alias("final_probability"),
        F.count(F.lit(1)).alias("n_times"))
    med = curves.where(F.col("state") == 0).agg(
        F.min(F.when(F.col("probability") <= 0.5, F.col("time"))).alias("median_stay"))
    stay = med.first()[0]  # one number
    return per.withColumn("median_stay", F.lit(float("nan") if stay is None else float(stay)))
