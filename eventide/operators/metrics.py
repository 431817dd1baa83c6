"""Evaluation metrics: IPCW Brier, integrated Brier, cumulative/dynamic AUC,
evaluation grids, bootstrap intervals and calibration (E02-E07, E09).

Predictions are columns on the subject rows: ``S_k`` is the predicted
survival at horizon k.  All horizons of one metric are evaluated in a single
aggregate (one column per horizon) instead of exploding rows per horizon.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.exprs import TWO_32
from eventide.operators.quantiles import column_quantiles
from eventide.plans.scan import SINGLE_WINDOW_MAX_ROWS, cumulative

BROADCAST_TIMES = 1_000_000


def censoring_km(df: DataFrame, time: str = "t", event: str = "e") -> DataFrame:
    """KM of the censoring distribution G(t); events leave the risk set first at tied times."""
    e = F.col(event).cast("long")
    tt = df.groupBy(F.col(time).cast("double").alias("time")).agg(
        F.sum(e).alias("d"), F.sum(1 - e).alias("c"), F.count(F.lit(1)).alias("m"))
    tt = tt.persist(StorageLevel.MEMORY_AND_DISK)
    two = tt.count() > SINGLE_WINDOW_MAX_ROWS
    tt = cumulative(tt, "time", [], sums={"n": "m"}, descending=True, force_two_level=two)
    f = F.coalesce(1.0 - F.try_divide(F.col("c").cast("double"), (F.col("n") - F.col("d")).cast("double")),
                   F.lit(1.0))
    g = cumulative(tt.withColumn("_f", f), "time", [], products={"G": "_f"}, force_two_level=two)
    return g.select("time", "G").persist(StorageLevel.MEMORY_AND_DISK)


def g_at(G: DataFrame, horizons: Sequence[float]) -> list[float]:
    """G at each horizon (right-continuous; 1 before the first time) — one aggregate."""
    row = G.agg(*[F.max_by(F.col("G"), F.when(F.col("time") <= float(h), F.col("time"))).alias(f"g{i}")
                  for i, h in enumerate(horizons)]).first()
    return [1.0 if row[f"g{i}"] is None else float(row[f"g{i}"]) for i in range(len(horizons))]


def _with_gt(df: DataFrame, G: DataFrame, time: str) -> DataFrame:
    n = G.count()
    Gj = G.select(F.col("time").alias("_gt_time"), F.col("G").alias("_G_T"))
    Gj = F.broadcast(Gj) if n <= BROADCAST_TIMES else Gj
    return df.join(Gj, F.col(time).cast("double") == F.col("_gt_time"), "left").drop("_gt_time")


def brier_scores(df: DataFrame, horizons: Sequence[float], surv_cols: Sequence[str],
                 time: str = "t", event: str = "e", G: DataFrame | None = None) -> DataFrame:
    """IPCW Brier score at each horizon -> (time, brier).

    term = S^2 1[T<=h, E=1]/G(T) + (1-S)^2 1[T>h]/G(h); weights with G = 0 count 0.
    """
    G = G if G is not None else censoring_km(df, time, event)
    gh = g_at(G, horizons)
    j = _with_gt(df, G, time)
    T = F.col(time).cast("double")
    E = F.col(event).cast("int")
    aggs = []
    for k, (h, s) in enumerate(zip(horizons, surv_cols)):
        S = F.col(s)
        case = F.when((T <= h) & (E == 1), F.coalesce(F.try_divide(S * S, F.col("_G_T")), F.lit(0.0)))
        ctrl = F.when(T > h, (1.0 - S) * (1.0 - S) / gh[k] if gh[k] > 0 else F.lit(0.0))
        aggs.append(F.avg(F.coalesce(case, ctrl, F.lit(0.0))).alias(f"b{k}"))
    row = j.agg(*aggs).first()
    rows = [(float(h), float(row[f"b{k}"]) if row[f"b{k}"] is not None else None)
            for k, h in enumerate(horizons)]
    return df.sparkSession.createDataFrame(rows, "time double, brier double")


def integrate(points: list[tuple[float, float]]) -> float:
    """Trapezoid integral divided by the span (the integrated score)."""
    pts = sorted((t, v) for t, v in points if v is not None)
    if len(pts) < 2:
        return pts[0][1] if pts else float("nan")
    area = sum((t2 - t1) * (v1 + v2) / 2.0 for (t1, v1), (t2, v2) in zip(pts, pts[1:]))
    return area / (pts[-1][0] - pts[0][0])


def brier_grid(df: DataFrame, time: str = "t", event: str = "e", n: int = 100) -> list[float]:
    """E03 grid: n evenly spaced points over [min, max] event time."""
    r = df.where(F.col(event) == 1).agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    if n <= 1 or hi <= lo:
        return [lo]
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def integrated_brier(brier: DataFrame) -> float:
    """Trapezoid over the Brier curve / span."""
    return integrate([(r["time"], r["brier"]) for r in brier.collect()])


def dynamic_auc(df: DataFrame, horizons: Sequence[float], risk: str = "risk", time: str = "t",
                event: str = "e", G: DataFrame | None = None) -> DataFrame:
    """cumulative/dynamic AUC per horizon -> (time, auc).

    Cases T <= h with the event, weighted 1/G(T); controls T > h.  Per horizon,
    (risk value) groups of weighted cases and controls and one running sum over
    risk give sum_cases w (controls below + half the tied controls).
    """
    G = G if G is not None else censoring_km(df, time, event)
    j = _with_gt(df, G, time)
    T = F.col(time).cast("double")
    E = F.col(event).cast("int")
    hz = F.explode(F.array(*[F.lit(float(h)) for h in horizons])).alias("h")
    x = j.select(T.alias("T"), E.alias("E"), F.col(risk).cast("double").alias("r"),
                 F.col("_G_T"), hz)
    wcase = F.when((F.col("T") <= F.col("h")) & (F.col("E") == 1),
                   F.coalesce(F.try_divide(F.lit(1.0), F.col("_G_T")), F.lit(0.0))).otherwise(0.0)
    ctrl = F.when(F.col("T") > F.col("h"), 1.0).otherwise(0.0)
    g = x.groupBy("h", "r").agg(F.sum(wcase).alias("wc"), F.sum(ctrl).alias("nc"))
    g = cumulative(g, "r", ["h"], sums={"nc_le": "nc"})
    num = F.sum(F.col("wc") * (F.col("nc_le") - F.col("nc") + 0.5 * F.col("nc")))
    out = g.groupBy("h").agg(num.alias("num"), F.sum("wc").alias("wsum"), F.sum("nc").alias("ncs"))
    return out.select(F.col("h").alias("time"),
                      F.try_divide(F.col("num"), F.col("wsum") * F.col("ncs")).alias("auc"))


def integrated_auc(auc: DataFrame, surv_at_horizons: dict[float, float]) -> float:
    """Mean AUC weighted by the drop of the KM survival between horizons."""
    pts = sorted((r["time"], r["auc"]) for r in auc.collect())
    prev = 1.0
    num = 0.0
    for t, a in pts:
        s = surv_at_horizons[t]
        if a is not None:
            num += a * (prev - s)
        prev = s
    denom = 1.0 - surv_at_horizons[pts[-1][0]] if pts else 0.0
    return num / denom if denom > 0 else float("nan")


def evaluation_times(df: DataFrame, time: str = "t", event: str = "e") -> list[float]:
    """Percentiles 10/25/50/75/90 of T; else 10 even points over event times; else 0..max."""
    q = column_quantiles(df, [time], [0.1, 0.25, 0.5, 0.75, 0.9])[time]
    if None not in q and len(set(q)) == 5:
        return [float(v) for v in q]
    r = df.where(F.col(event) == 1).agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    if r["lo"] is not None and r["hi"] > r["lo"]:
        return [float(r["lo"]) + (float(r["hi"]) - float(r["lo"])) * i / 9 for i in range(10)]
    mx = df.agg(F.max(time)).first()[0] or 1.0
    return [float(mx) * i / 9 for i in range(10)]


# Poisson(1) cumulative probabilities for k = 0..11: bootstrap weight = smallest k with u < CDF(k)
_POIS_CDF = []
_acc = 0.0
for _k in range(12):
    _acc += math.exp(-1.0) / math.factorial(_k)
    _POIS_CDF.append(_acc)


def poisson_weight(u: F.Column) -> F.Column:
    expr = F.lit(len(_POIS_CDF))
    for k in reversed(range(len(_POIS_CDF))):
        expr = F.when(u < F.lit(_POIS_CDF[k]), F.lit(k)).otherwise(expr)
    return expr


def poisson_weights(ids: Sequence[str | None], n_boot: int, seed: int) -> np.ndarray:
    """``poisson_weight`` of md5(seed:rep:id), ids x replicates; a missing id leaves seed:rep."""
    tails = [b"" if i is None else b":" + i.encode() for i in ids]
    out = np.empty((len(tails), n_boot), np.uint8)
    for rep in range(n_boot):
        start = hashlib.md5(f"{seed}:{rep}".encode())
        drawn = bytearray()
        for tail in tails:
            h = start.copy()
            h.update(tail)
            drawn += h.digest()[:4]
        out[:, rep] = np.searchsorted(_POIS_CDF, np.frombuffer(drawn, ">u4") / TWO_32, side="right")
    return out


def bootstrap_ci(df: DataFrame, id_col: str = "id", time: str = "t", event: str = "e",
                 risk: str = "risk", n_boot: int = 100, seed: int = 42, level: float = 0.95) -> dict:
    """Percentile interval of the c-index over Poisson(1)-weighted replicates.

    Replicate weights are md5(seed:rep:id) draws, so each replicate differs and
    the whole set is reproducible.  Rows carry all their weights and are not copied once a replicate.
    """
    from eventide.operators.concordance import replicate_counts
    rows = []
    for r in replicate_counts(df, n_boot, lambda ids: poisson_weights(ids, n_boot, seed), id_col, time, event, risk):
        pairs = r["conc"] + r["disc"] + r["tied"]
        if r["weight"] > 0:  # a replicate that drew no row has no index
            rows.append(((r["conc"] + 0.5 * r["tied"]) / pairs if pairs > 0 else float("nan"),))
    per = df.sparkSession.createDataFrame(rows, "c_index double")
    a = (1 - level) / 2
    q = per.agg(F.percentile("c_index", [a, 1 - a]).alias("q"), F.avg("c_index").alias("m")).first()
    return {"lower": q["q"][0], "upper": q["q"][1], "mean": q["m"], "replicates": n_boot}


def expected_observed(df: DataFrame, km_surv_at: dict[float, float], surv_cols: Sequence[str],
                      horizons: Sequence[float]) -> DataFrame:
    """Predicted vs KM event probability at horizons: (time, expected, observed, ratio)."""
    row = df.agg(*[F.avg(1.0 - F.col(c)).alias(f"x{k}") for k, c in enumerate(surv_cols)]).first()
    rows = []
    for k, h in enumerate(horizons):
        exp_ = float(row[f"x{k}"])
        obs = 1.0 - km_surv_at[h]
        rows.append((float(h), exp_, obs, exp_ / obs if obs > 0 else float("nan")))
    return df.sparkSession.createDataFrame(rows, "time double, expected double, observed double, ratio double")


def brier_long(pred: DataFrame, rows: DataFrame, id_col: str, time: str = "t", event: str = "e",
               G: DataFrame | None = None) -> DataFrame:
    """E02 on long predictions (id, time = horizon, survival): one group per horizon."""
    G = G if G is not None else censoring_km(rows, time, event)
    horizons = [r["time"] for r in pred.select("time").distinct().collect()]  # the requested grid
    return _brier_means(pred.join(with_outcome(rows, id_col, time, event, G), id_col, "inner"), horizons, G)


def with_outcome(rows: DataFrame, id_col: str, time: str, event: str, G: DataFrame) -> DataFrame:
    """(id, _T, _E, _G_T): what a Brier score needs of each row."""
    return _with_gt(rows.select(id_col, F.col(time).alias("_T"), F.col(event).alias("_E")), G, "_T")


def brier_of(est, rows: DataFrame, horizons: Sequence[float], id_col: str, time: str = "t", event: str = "e") -> DataFrame:
    """E02 of a fitted estimator: outcomes are joined to the rows, not to their predictions (rows x horizons),
    which are averaged where they are made."""
    G = censoring_km(rows, time, event)
    outcome = with_outcome(rows, id_col, time, event, G)
    pred = est.predict_survival(rows.join(outcome, id_col, "inner"), horizons, [id_col, "_T", "_E", "_G_T"])
    return _brier_means(pred, sorted(set(horizons)), G)


def _brier_means(j: DataFrame, horizons: Sequence[float], G: DataFrame) -> DataFrame:
    gh = g_at(G, horizons)
    ghm = F.create_map(*[x for h, g in zip(horizons, gh) for x in (F.lit(float(h)), F.lit(float(g)))])
    j = j.withColumn("_gh", F.element_at(ghm, F.col("time")))
    S = F.col("survival")
    case = F.when((F.col("_T") <= F.col("time")) & (F.col("_E") == 1),
                  F.coalesce(F.try_divide(S * S, F.col("_G_T")), F.lit(0.0)))
    ctrl = F.when(F.col("_T") > F.col("time"),
                  F.coalesce(F.try_divide((1.0 - S) * (1.0 - S), F.col("_gh")), F.lit(0.0)))
    return j.groupBy("time").agg(F.avg(F.coalesce(case, ctrl, F.lit(0.0))).alias("brier"))
