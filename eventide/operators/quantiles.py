"""Exact quantiles at any size, from value counts and running counts.

Values are counted per column (and group) with a map-side combine, the counts are cumulated in
value order (``plans/scan.cumulative``, whose two-level form bounds every task), and the two ranks
around each quantile are picked and interpolated.  No aggregation buffer holds a column's values, so
the same exact answer comes out of one algorithm however large the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.scan import cumulative


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: str | None = None,
                    force_two_level: bool | None = None) -> DataFrame:
    """One row (per ``by`` group): ``q{i}_{j}``, the quantile ``probs[j]`` of ``cols[i]`` (linear
    interpolation, nulls left out, NaN above every number; null where a column has no value).

    Groups in which every column is null have no row.
    """
    key = [F.col(_q(by)).alias("_by")] if by else []
    names = ["_by"] if by else []
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(_q(c)).cast("double").alias("v"))
                                 for i, c in enumerate(cols)])).alias("_x")
    counts = (df.select(*key, values).select(*names, F.col("_x.i").alias("_col"), F.col("_x.v").alias("_value"))
              .where(F.col("_value").isNotNull()).groupBy(*names, "_col", "_value").agg(F.count(F.lit(1)).alias("_n")))
    out = counts_quantiles(counts, len(cols), probs, names, force_two_level)
    return out.withColumnRenamed("_by", by) if by else out


def counts_quantiles(counts: DataFrame, n_cols: int, probs: Sequence[float], names: Sequence[str] = (),
                     force_two_level: bool | None = None) -> DataFrame:
    """The quantiles ``q{i}_{j}`` from value counts (names..., _col, _value, _n), _col from 0 to ``n_cols`` - 1."""
    names = list(names)
    upto = cumulative(counts, "_value", [*names, "_col"], sums={"_upto": "_n"}, force_two_level=force_two_level)
    total = counts.groupBy(*names, "_col").agg(F.sum("_n").alias("_total"))
    total = total.select(*[F.col(n).alias(f"{n}_t") for n in [*names, "_col"]], "_total")
    same = F.lit(True)
    for n in [*names, "_col"]:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_t"))
    ranked = upto.join(total, same).withColumn("_before", F.col("_upto") - F.col("_n"))
    aggs = []
    for i in range(n_cols):
        for j, p in enumerate(probs):
            at = F.lit(float(p)) * (F.col("_total") - 1)
            for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                here = (F.col("_col") == i) & (F.col("_before") <= rank) & (rank < F.col("_upto"))
                aggs.append(F.max(F.when(here, F.col("_value"))).alias(f"{side}{i}_{j}"))
            aggs.append(F.max(F.when(F.col("_col") == i, at - F.floor(at))).alias(f"part{i}_{j}"))
    wide = ranked.groupBy(*names).agg(*aggs)
    out = [F.col(n) for n in names]
    for i in range(n_cols):
        for j in range(len(probs)):
            lo, hi, part = (F.col(f"{s}{i}_{j}") for s in ("lo", "hi", "part"))
            out.append(F.when((part == 0) | (lo == hi), lo).otherwise(lo + (hi - lo) * part).alias(f"q{i}_{j}"))
    return wide.select(*out)


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """The quantiles of each column as numbers on the driver (None where a column has no value)."""
    row = exact_quantiles(df, cols, probs).first()
    return {c: [row[f"q{i}_{j}"] if row else None for j in range(len(probs))] for i, c in enumerate(cols)}
