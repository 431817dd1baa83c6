"""Report and chart tables (T-rows, M22): data only, every table a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators import risk as K
from eventide.operators.quantiles import column_quantiles, exact_quantiles

GROUP_ORDER = ("low", "medium", "high")


def risk_thresholds(df: DataFrame, risk: str, thresholds=(0.25, 0.75), mode: str = "quantile") -> tuple:
    """``score``: the numbers as given; ``quantile``: those percentiles of the risk column."""
    if mode == "score":
        return float(thresholds[0]), float(thresholds[1])
    q = column_quantiles(df, [risk], [float(thresholds[0]), float(thresholds[1])])[risk]
    return float(q[0]), float(q[1])


def assign_risk_group(df: DataFrame, risk: str, lo: float, hi: float, out: str = "risk_group") -> DataFrame:
    r = F.col(risk)
    return df.withColumn(out, F.when(r <= lo, "low").when(r >= hi, "high").otherwise("medium"))


def risk_groups(df: DataFrame, risk: str, thresholds=(0.25, 0.75), mode: str = "quantile") -> DataFrame:
    """Count and percent per risk group plus the thresholds used."""
    lo, hi = risk_thresholds(df, risk, thresholds, mode)
    g = assign_risk_group(df, risk, lo, hi)
    total = F.sum("count").over(Window.partitionBy())  # 3-row table
    return (g.groupBy("risk_group").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("percent", 100.0 * F.col("count") / total)
            .withColumn("low_threshold", F.lit(lo)).withColumn("high_threshold", F.lit(hi)))


def risk_group_table(df: DataFrame, group: str = "risk_group", time: str = "t", event: str = "e") -> DataFrame:
    """N, proportion, events and KM median per group."""
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    total = F.sum("n").over(Window.partitionBy())
    curves = K.kaplan_meier(df, time, event, group, with_ci=False)
    med = K.median_survival(curves, group)
    return base.withColumn("proportion", F.col("n") / total).join(med, group, "left")


def group_hazard_ratios(df: DataFrame, group: str, reference: str, time: str = "t", event: str = "e",
                        levels: Sequence[str] | None = None) -> DataFrame:
    """T02 (HR column): Cox on group dummies vs the reference group."""
    from eventide.operators.cox import cox_fit
    from eventide.operators.logrank import group_values
    lv = list(levels) if levels is not None else [v for v in group_values(df, group) if v != reference]
    x = df.select(time, event, *[(F.col(group) == v).cast("double").alias(f"g_{v}") for v in lv])
    m = cox_fit(x, time, event, [f"g_{v}" for v in lv], with_concordance=False)
    c = m.coefficients(df.sparkSession)
    return c.select(F.regexp_replace("feature", "^g_", "").alias(group), "hazard_ratio", "hr_lower",
                    "hr_upper", "p_value")


def group_profile(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Per group mean and median of each numeric column."""
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in cols])
    medians = exact_quantiles(df, cols, [0.5], by=group).withColumnRenamed(group, "_group")
    out = means.join(medians, F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.select(group, "n", *[x for i, c in enumerate(cols) for x in (F.col(f"{c}_mean"), F.col(f"q{i}_0").alias(f"{c}_median"))])


def survival_by_group(df: DataFrame, group: str, horizons: Sequence[float], time: str = "t",
                      event: str = "e") -> DataFrame:
    """KM per group with CI at the horizons."""
    curves = K.kaplan_meier(df, time, event, group)
    return K.survival_at(curves, horizons, group)


def median_ci(curve: DataFrame, strata=None) -> DataFrame:
    """Median with its interval: first times where S, upper and lower bands reach 0.5."""
    s = K._strata(strata)
    inf = F.lit(float("inf"))
    return curve.groupBy(*s).agg(
        F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))), inf).alias("median_time"),
        F.coalesce(F.min(F.when(F.col("ci_lower") <= 0.5, F.col("time"))), inf).alias("median_lower"),
        F.coalesce(F.min(F.when(F.col("ci_upper") <= 0.5, F.col("time"))), inf).alias("median_upper"))


def survival_summary(df: DataFrame, time: str = "t", event: str = "e") -> DataFrame:
    """N, events, event rate, median with CI (one row)."""
    curve = K.kaplan_meier(df, time, event)
    med = median_ci(curve)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"),
                 F.max(F.col(time).cast("double")).alias("max_followup"))
    # both sides are one row: join on a constant key (no cross join)
    return (agg.withColumn("_k", F.lit(1)).join(med.withColumn("_k", F.lit(1)), "_k")
            .drop("_k").withColumn("event_rate", F.col("events") / F.col("n")))


def trend_table(df: DataFrame, horizons: Sequence[float], time: str = "t", event: str = "e") -> DataFrame:
    """Survival and CI at the requested horizons."""
    return K.survival_at(K.kaplan_meier(df, time, event), horizons)


def performance_by_period(df: DataFrame, period_col: str, time: str = "t", event: str = "e",
                          risk: str = "risk") -> DataFrame:
    """C-index, n and events per cohort period (one grouped concordance job)."""
    from eventide.operators.concordance import concordance_by
    c = concordance_by(df, [period_col], time, event, risk)
    n = df.groupBy(period_col).agg(F.count(F.lit(1)).alias("n"),
                                   F.sum(F.col(event).cast("long")).alias("events"))
    return n.join(c.select(period_col, "c_index"), period_col, "left")


def period_metrics(df: DataFrame, period_col: str, horizon: float, surv_col: str, time: str = "t",
                   event: str = "e", risk: str = "risk") -> DataFrame:
    """T08 (Brier, AUC): per cohort period, IPCW Brier and cumulative/dynamic AUC at one horizon,
    each period with its own censoring distribution.  All periods are computed together:
    the censoring KM and the AUC running sums are partitioned by period, the rest are grouped
    aggregates — a fixed number of jobs however many periods there are."""
    from eventide.plans.scan import cumulative
    by = [period_col]
    T_, E_ = F.col(time).cast("double"), F.col(event).cast("int")
    x = df.select(*by, T_.alias("_T"), E_.alias("_E"), F.col(surv_col).alias("_S"),
                  F.col(risk).cast("double").alias("_r"))
    # censoring KM per period: events leave the risk set first at tied times
    tt = x.groupBy(*by, F.col("_T").alias("time")).agg(
        F.sum("_E").alias("d"), F.sum(1 - F.col("_E")).alias("c"), F.count(F.lit(1)).alias("m"))
    tt = cumulative(tt, "time", by, sums={"n": "m"}, descending=True)
    f = F.coalesce(1.0 - F.try_divide(F.col("c").cast("double"), (F.col("n") - F.col("d")).cast("double")),
                   F.lit(1.0))
    G = cumulative(tt.withColumn("_f", f), "time", by, products={"G": "_f"}).select(*by, "time", "G")
    gh = G.groupBy(*by).agg(F.max_by("G", F.when(F.col("time") <= horizon, F.col("time"))).alias("_gh"))
    j = (x.join(G.withColumnRenamed("time", "_T").withColumnRenamed("G", "_GT"), [*by, "_T"], "left")
         .join(gh, by, "left").withColumn("_gh", F.coalesce("_gh", F.lit(1.0))))
    S = F.col("_S")
    case = F.when((F.col("_T") <= horizon) & (F.col("_E") == 1), F.coalesce(F.try_divide(S * S, F.col("_GT")),
                                                                           F.lit(0.0)))
    ctrl = F.when(F.col("_T") > horizon, F.coalesce(F.try_divide((1.0 - S) * (1.0 - S), F.col("_gh")), F.lit(0.0)))
    brier = j.groupBy(*by).agg(F.avg(F.coalesce(case, ctrl, F.lit(0.0))).alias("brier"))
    wc = F.when((F.col("_T") <= horizon) & (F.col("_E") == 1),
                F.coalesce(F.try_divide(F.lit(1.0), F.col("_GT")), F.lit(0.0))).otherwise(0.0)
    nc = F.when(F.col("_T") > horizon, 1.0).otherwise(0.0)
    g = j.groupBy(*by, "_r").agg(F.sum(wc).alias("wc"), F.sum(nc).alias("nc"))
    g = cumulative(g, "_r", by, sums={"nc_le": "nc"})
    auc = g.groupBy(*by).agg(F.try_divide(F.sum(F.col("wc") * (F.col("nc_le") - 0.5 * F.col("nc"))),
                                          F.sum("wc") * F.sum("nc")).alias("auc"))
    return brier.join(auc, by, "full_outer").select(*by, F.lit(float(horizon)).alias("horizon"), "brier", "auc")


def trend_factors(coefs: DataFrame) -> DataFrame:
    """Name, direction, magnitude, confidence = 1 - p."""
    return coefs.select(F.col("feature").alias("name"),
                        F.when(F.col("coef") > 0, "increases_risk").when(F.col("coef") < 0, "decreases_risk")
                        .otherwise("none").alias("direction"),
                        F.abs("coef").alias("magnitude"), (1.0 - F.col("p_value")).alias("confidence"))


def survival_curve_view(curves: DataFrame, strata=None) -> DataFrame:
    """Curve points with CI and at-risk counts for charting."""
    s = K._strata(strata)
    return curves.select(*s, "time", "survival", F.col("ci_lower").alias("lower"),
                         F.col("ci_upper").alias("upper"), F.col("n_at_risk").alias("at_risk"))


def hazard_ratio_view(coefs: DataFrame, sort: str = "value", top_n: int | None = None) -> DataFrame:
    """Hazard ratios sorted by value, |log HR| or name; optional top n."""
    key = {"value": F.col("hazard_ratio").desc(), "abs_value": F.abs("coef").desc(),
           "name": F.col("feature").asc()}[sort]
    out = coefs.select("feature", "coef", "hazard_ratio", "hr_lower", "hr_upper", "p_value") \
        .orderBy(key, F.col("feature"))
    return out.limit(top_n) if top_n else out


def feature_importance_view(importance: DataFrame, top_n: int = 10) -> DataFrame:
    """Top n features by importance."""
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(top_n)


def transition_counts(df: DataFrame, state: str = "state", next_state: str = "next_state") -> DataFrame:
    """From x to counts and row probabilities (transition matrix, long form)."""
    c = (df.where(F.col(next_state).isNotNull())
         .groupBy(F.col(state).alias("from_state"), F.col(next_state).alias("to_state"))
         .agg(F.count(F.lit(1)).alias("count")))
    row_total = F.sum("count").over(Window.partitionBy("from_state"))
    return c.withColumn("probability", F.col("count") / row_total)


def risk_heatmap(df: DataFrame, f1: str, f2: str, risk: str, bins: int = 5,
                 thresholds=(0.25, 0.5, 0.75), binning: str = "equal_width") -> DataFrame:
    """Mean risk per (f1, f2) cell (equal-width or quantile bins) and its band by thresholds."""
    mm = df.agg(F.min(f1).alias("a0"), F.max(f1).alias("a1"), F.min(f2).alias("b0"),
                F.max(f2).alias("b1")).first()

    def binexpr(c, lo, hi):
        if binning == "quantile":
            cuts = column_quantiles(df, [c], [i / bins for i in range(1, bins)])[c]
            e = F.lit(0)
            for cut in cuts:
                e = e + (F.col(c) > float(cut)).cast("int")
            return e
        wdt = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(wdt)), F.lit(bins - 1)).cast("int")

    g = df.groupBy(binexpr(f1, mm["a0"], mm["a1"]).alias("bin_x"), binexpr(f2, mm["b0"], mm["b1"]).alias("bin_y")) \
        .agg(F.avg(F.col(risk).cast("double")).alias("mean_risk"), F.count(F.lit(1)).alias("n"))
    t1, t2, t3 = thresholds
    band = (F.when(F.col("mean_risk") < t1, "low").when(F.col("mean_risk") < t2, "medium_low")
            .when(F.col("mean_risk") < t3, "medium_high").otherwise("high"))
    return g.withColumn("band", band)


def time_dependent_view(brier: DataFrame, auc: DataFrame) -> DataFrame:
    """Brier and AUC over time, one row per horizon."""
    return brier.join(auc, "time", "full_outer").orderBy("time")
