"""Risk tables and the non-parametric estimators built on them.

The one distributed primitive: group by (strata, time), then running sums over
ordered times (``eventide.plans.scan.cumulative``).  Everything here returns
long tables ``(strata..., time, ...)``.

Conventions: events precede censoring at equal times; S is right-continuous;
curves carry a time-0 row with S = 1; the median is the first time with
S <= 0.5 and +inf if S never gets there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.stats import Z95
from eventide.plans.scan import SINGLE_WINDOW_MAX_ROWS, cumulative

INF = float("inf")


def _strata(strata) -> list[str]:
    if strata is None:
        return []
    if isinstance(strata, str):
        return [strata]
    return list(strata)


def risk_table(df: DataFrame, time: str = "t", event: str = "e", strata=None,
               weight: str | None = None, force_two_level: bool | None = None) -> DataFrame:
    return _risk_table(df, time, event, strata, weight, force_two_level)[0]


def _risk_table(df: DataFrame, time: str = "t", event: str = "e", strata=None,
                weight: str | None = None, force_two_level: bool | None = None):
    """Per (strata, time) the events, censored and number at risk.

    Output: ``strata..., time, n_at_risk, n_event, n_censored`` (weighted
    counts are doubles when ``weight`` is given).  The grouped table is
    persisted because every estimator reads it several times.
    """
    s = _strata(strata)
    for c in s + [time, event]:
        if c not in df.columns:
            raise ValueError(f"column {c!r} not in table")
    w = F.col(weight) if weight else F.lit(1)
    ev = F.col(event).cast("int")
    grouped = df.groupBy(*s, F.col(time).cast("double").alias("time")).agg(
        F.sum(w * ev).alias("n_event"),
        F.sum(w * (1 - ev)).alias("n_censored"),
        F.sum(w).alias("_leave"),
    )
    if not weight:
        grouped = grouped.select(*s, "time", F.col("n_event").cast("long"),
                                 F.col("n_censored").cast("long"), F.col("_leave").cast("long"))
    grouped = grouped.persist(StorageLevel.MEMORY_AND_DISK)
    if force_two_level is None:  # decide once for every scan over this time table
        force_two_level = grouped.count() > SINGLE_WINDOW_MAX_ROWS
    out = cumulative(grouped, "time", s, sums={"n_at_risk": "_leave"}, descending=True,
                     force_two_level=force_two_level)
    return out.select(*s, "time", "n_at_risk", "n_event", "n_censored"), force_two_level


def kaplan_meier(df: DataFrame, time: str = "t", event: str = "e", strata=None,
                 with_ci: bool = True, z: float = Z95,
                 force_two_level: bool | None = None, keep_greenwood: bool = False) -> DataFrame:
    """Kaplan-Meier curves, one per stratum, log-log Greenwood CI.

    Output: ``strata..., time, n_at_risk, n_event, n_censored, survival,
    ci_lower, ci_upper`` including a time-0 row per stratum.
    """
    s = _strata(strata)
    rt, force_two_level = _risk_table(df, time, event, s, force_two_level=force_two_level)
    n = F.col("n_at_risk").cast("double")
    d = F.col("n_event").cast("double")
    rt = rt.withColumn("_f", 1.0 - d / n).withColumn("_g", F.try_divide(d, n * (n - d)))
    curve = cumulative(rt, "time", s, sums={"_gw": "_g"}, products={"survival": "_f"},
                       force_two_level=force_two_level)
    curve = curve.select(*s, "time", "n_at_risk", "n_event", "n_censored", "survival", "_gw")
    # the at-risk count at the earliest time is the stratum size: no second pass over the input
    start = (rt.groupBy(*s).agg(F.max("n_at_risk").alias("n_at_risk")).where(F.col("n_at_risk").isNotNull())
             .select(*s, F.lit(0.0).alias("time"), "n_at_risk", F.lit(0).cast("long").alias("n_event"),
                     F.lit(0).cast("long").alias("n_censored"), F.lit(1.0).alias("survival"),
                     F.lit(0.0).alias("_gw")))
    curve = curve.unionByName(start)
    if keep_greenwood:
        curve = curve.withColumnRenamed("_gw", "greenwood_variance")
    if not with_ci:
        return curve.drop("_gw")
    return add_loglog_ci(curve, "survival", "_gw", z).drop("_gw")


def add_loglog_ci(curve: DataFrame, surv: str, greenwood: str, z: float = Z95) -> DataFrame:
    """Exponential-Greenwood (log-log) pointwise interval.

    lower = S^exp(z*se), upper = S^exp(-z*se), se = sqrt(V)/|log S|.
    S = 1 gives (1, 1); S = 0 gives (0, 0).
    """
    S = F.col(surv)
    logs = F.log(S)
    se = F.sqrt(F.col(greenwood)) / (-logs)
    lo = F.when(S >= 1.0, 1.0).when(S <= 0.0, 0.0).otherwise(F.exp(logs * F.exp(F.lit(z) * se)))
    hi = F.when(S >= 1.0, 1.0).when(S <= 0.0, 0.0).otherwise(F.exp(logs * F.exp(-F.lit(z) * se)))
    return curve.withColumn("ci_lower", lo).withColumn("ci_upper", hi)


def median_survival(curves: DataFrame, strata=None, surv: str = "survival") -> DataFrame:
    """First time with S <= 0.5 per stratum; +inf if never."""
    s = _strata(strata)
    return curves.groupBy(*s).agg(
        F.coalesce(F.min(F.when(F.col(surv) <= 0.5, F.col("time"))), F.lit(INF)).alias("median_time"))


def median_by_row(df: DataFrame, curves: DataFrame, strata: str,
                  overall_curve: DataFrame) -> DataFrame:
    """Each row gets its stratum's median, else the overall median, else NaN."""
    by = median_survival(curves, strata)
    overall = median_survival(overall_curve).first()  # one number
    fallback = overall[0] if overall is not None else float("nan")
    out = df.join(by, on=strata, how="left")
    return out.withColumn("median_time", F.coalesce("median_time", F.lit(fallback)))


def nelson_aalen(df: DataFrame, time: str = "t", event: str = "e", strata=None,
                 force_two_level: bool | None = None) -> DataFrame:
    """Cumulative hazard H(t) = sum d/n with variance sum d/n^2."""
    s = _strata(strata)
    rt, force_two_level = _risk_table(df, time, event, s, force_two_level=force_two_level)
    n = F.col("n_at_risk").cast("double")
    d = F.col("n_event").cast("double")
    rt = rt.withColumn("_h", d / n).withColumn("_v", d / (n * n))
    out = cumulative(rt, "time", s, sums={"cumulative_hazard": "_h", "variance": "_v"},
                     force_two_level=force_two_level)
    return out.select(*s, "time", "n_at_risk", "n_event", "cumulative_hazard", "variance")


def survival_at(curves: DataFrame, times: Sequence[float], strata=None,
                cols: Sequence[str] = ("survival", "ci_lower", "ci_upper", "n_at_risk")) -> DataFrame:
    """Value of each curve at given horizons (right-continuous step lookup)."""
    from eventide.operators.lookup import step_lookup
    s = _strata(strata)
    spark = curves.sparkSession
    grid = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("time")
    if s:
        pts = curves.select(*s).distinct().select(*s, grid)
    else:
        pts = spark.range(1).select(grid)
    return step_lookup(curves, pts, s, "time", list(cols))


def km_predictions(df: DataFrame, curves: DataFrame, strata: str, horizons: Sequence[float],
                   prefix: str = "S_") -> DataFrame:
    """Per-row predicted survival at each horizon from stratified KM curves.

    The (strata x horizons) table is tiny; it is pivoted to one row per
    stratum and joined to the rows (broadcast: one row per stratum value).
    """
    at = survival_at(curves, horizons, strata, cols=["survival"])
    wide = at.groupBy(strata).agg(*[
        F.max(F.when(F.col("time") == float(h), F.col("survival"))).alias(f"{prefix}{k}")
        for k, h in enumerate(horizons)])
    from eventide.operators.relational import maybe_broadcast
    return df.join(maybe_broadcast(wide), on=strata, how="left")
