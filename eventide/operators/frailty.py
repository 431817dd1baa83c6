"""Shared gamma frailty Cox model by EM (M08; Klein 1992).

Frailty z_k ~ Gamma(mean 1, variance theta) per cluster.
E-step (one groupBy(cluster)):  z_k = (D_k + 1/theta) / (Lambda_k + 1/theta),
    E[log z_k] = psi(D_k + 1/theta) - log(Lambda_k + 1/theta),
    Lambda_k = sum_{i in k} H0(T_i) exp(x_i b).
M-step: Cox fit with offset log z_k (Breslow ties), warm-started; theta from
the 1-D maximisation of the expected gamma log-density (driver, two sums).
The per-cluster frailty table is checkpointed every iteration so the lineage
does not grow with the number of EM rounds.  Rows are dealt by cluster and sorted
once (``_dealt``; a large cluster in several parts), so a round only moves the
cluster table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.special import digamma, digamma_col, trigamma
from eventide.operators.cox import BROADCAST_TIMES, CoxModel, _eta, _fit_standardised, _standardised
from eventide.plans.scan import ROWS_PER_PARTITION, right_size
from eventide.session import cut_lineage


@dataclass
class FrailtyModel:
    cox: CoxModel
    theta: float
    iterations: int
    cluster: str
    frailties: DataFrame = field(repr=False, default=None)  # cluster, frailty, log_frailty

    def coefficients(self, spark) -> DataFrame:
        return self.cox.coefficients(spark)

    def summary(self) -> dict:
        s = self.cox.summary()
        p = len(self.cox.features)
        s.update({"theta": self.theta, "frailty_variance": self.theta, "em_iterations": self.iterations,
                  "aic": -2 * self.cox.loglik + 2 * (p + 1),
                  "bic": -2 * self.cox.loglik + (p + 1) * math.log(max(self.cox.n, 1))})
        return s

    def predict_risk(self, df: DataFrame) -> DataFrame:
        """Partial hazard times the cluster frailty (1 for unseen clusters)."""
        if self.cluster in df.columns:
            f = self.frailties.select(F.col("cluster").alias(self.cluster), "log_frailty")
            # the predictor is made first, so that covariates nobody reads afterwards do not travel
            x = df.withColumn("_lp", self.cox.linear_predictor(df, include_offset=False)).join(f, self.cluster, "left")
        else:  # every row is a cluster of its own, and no new row has been seen
            x = df.withColumns({"_lp": self.cox.linear_predictor(df, include_offset=False), "log_frailty": F.lit(0.0)})
        return x.withColumn("risk", F.exp(F.col("_lp") + F.coalesce("log_frailty", F.lit(0.0)))).drop("_lp")

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """Long table (keep..., time, survival): exp(-H0(t) * frailty * partial hazard)."""
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(h).alias("h0"))
                                   for t, h in zip(times, self.cox.baseline_at(times), strict=True)]))
        r = self.predict_risk(df).select(*keep, "risk", grid.alias("g"))
        return r.select(*keep, F.col("g.time").alias("time"), F.exp(-F.col("g.h0") * F.col("risk")).alias("survival"))


def _theta_update(K: int, s_log: float, s_z: float, theta: float) -> float:
    """Maximise K(v log v - lgamma v) + (v - 1) s_log - v s_z over v = 1/theta."""
    v = 1.0 / theta
    for _ in range(100):
        g = K * (math.log(v) + 1.0 - digamma(v)) + s_log - s_z
        h = K * (1.0 / v - trigamma(v))
        nv = v - g / h if h < 0 else v * 2.0
        if nv <= 0:
            nv = v / 2.0
        if abs(nv - v) < 1e-10 * v:
            v = nv
            break
        v = nv
    return min(max(1.0 / v, 1e-8), 1e8)


def frailty_fit(df: DataFrame, time: str, event: str, features: Sequence[str], cluster: str | None = None,
                theta0: float = 1.0, max_em: int = 30, tol: float = 1e-4) -> FrailtyModel:
    """Shared gamma frailty; ``cluster=None`` gives every row its own cluster."""
    feats = list(features)
    base = df.select(F.col(cluster).alias("_cl") if cluster else F.monotonically_increasing_id().alias("_cl"),
                     F.col(time).cast("double").alias(time), F.col(event).cast("int").alias(event),
                     *[F.col(f).cast("double").alias(f) for f in feats])
    base = cut_lineage(right_size(base))  # stable cluster ids and a short lineage for the EM loop
    rows = _standardised(base, time, event, feats, [F.col("_cl"), F.monotonically_increasing_id().alias("_row")])
    X, D, spread = _dealt(rows)
    rows.times(X)
    K = D.count()
    theta = theta0
    z = None
    model = None
    it = 0

    def with_offset():
        if z is None:
            return X.withColumn("off", F.lit(0.0))
        return X.join(z, ["_cl", "_part"], "left").withColumn("off", F.coalesce("logz", F.lit(0.0))).drop("logz")

    for it in range(1, max_em + 1):
        x = with_offset()
        # ECM: a couple of warm-started Newton steps per M-step; the EM loop does the rest
        model = _fit_standardised(x, rows, 0.0, 0.0, "breslow", "logz", 25 if model is None else 2, 1e-9,
                                  None if model is None else model.coef)
        bl = model.baseline.select(F.col("time").alias("t"), F.col("baseline_hazard").alias("_H0"))
        bl = F.broadcast(bl) if rows.n_times <= BROADCAST_TIMES else bl
        lam = (x.join(bl, "t", "left")
               .withColumn("_L", F.coalesce("_H0", F.lit(0.0)) * F.exp(_eta(len(feats), model.coef * rows.scales, False)))
               .groupBy("_cl").agg(F.sum("_L").alias("Lam")))
        v = 1.0 / theta
        est = D.join(lam, "_cl").select(
            "_cl", "_parts", ((F.col("D") + v) / (F.col("Lam") + v)).alias("ez"),
            (digamma_col(F.col("D") + v) - F.log(F.col("Lam") + v)).alias("elogz"))
        est = cut_lineage(est)
        sums = est.agg(F.sum("elogz").alias("sl"), F.sum("ez").alias("sz")).first()
        new_theta = _theta_update(K, float(sums["sl"]), float(sums["sz"]), theta)
        model.baseline.unpersist()
        if z is not None:
            z.unpersist()
        z = spread(est.select("_cl", "_parts", F.log("ez").alias("logz")))
        done = abs(new_theta - theta) <= tol * max(theta, 1e-8)
        theta = new_theta
        if done:
            break
    # final M-step to convergence at the last frailties
    x = with_offset()
    model = _fit_standardised(x, rows, 0.0, 0.0, "breslow", "logz", 25, 1e-9, model.coef if model is not None else None)
    logz = F.log("ez") if z is not None else F.lit(0.0)
    fr = (est if z is not None else D).select(F.col("_cl").alias("cluster"), F.exp(logz).alias("frailty"), logz.alias("log_frailty"))
    model.baseline.count()  # made while the dealt rows are still held
    for table in [X, D] + ([z] if z is not None else []):
        table.unpersist()
    return FrailtyModel(model, theta, it, cluster or "_row", fr)


def _dealt(rows) -> tuple[DataFrame, DataFrame, Callable]:
    """(rows, clusters, spread): rows dealt by (cluster, part) and sorted, held in the cache; clusters with their events
    ``D`` and their number of parts; and a function that deals a table of clusters the same way, so that neither side
    of a join of the two moves or is sorted again.  A cluster above a quarter of a partition has several parts."""
    n_parts = max(rows.table.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.n / ROWS_PER_PARTITION))
    each = max(1000, rows.n // (4 * n_parts))
    D = rows.table.groupBy("_cl").agg(F.sum(F.col("e").cast("double")).alias("D"), F.ceil(F.count(F.lit(1)) / each).cast("int").alias("_parts"))
    D = D.persist(StorageLevel.MEMORY_AND_DISK)
    large = F.broadcast(D.where("_parts > 1").select(F.col("_cl").alias("_large"), F.col("_parts").alias("_of")))  # few by their size

    def dealt(table):
        return table.repartition(n_parts, "_cl", "_part").sortWithinPartitions("_cl", "_part").persist(StorageLevel.MEMORY_AND_DISK)

    x = rows.table.join(large, F.col("_cl").eqNullSafe(F.col("_large")), "left")
    x = x.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_of")), F.lit(0)).cast("int")).drop("_large", "_of", "_row")
    return dealt(x), D, lambda table: dealt(table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts"))
