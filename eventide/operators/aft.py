"""Accelerated failure time models: Weibull, log-normal, log-logistic.

log T = b0 + x.b + sigma * W.  Newton-Raphson on (b0, b, log sigma): each
Arrow batch computes its partial gradient and Hessian with numpy
(``mapInPandas``), Spark sums the partials, the driver solves a (p+2) system.
The log-normal survival term needs erfc, which Spark SQL lacks — hence the
numpy step rather than column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.cox import _penalty
from eventide.functions.stats import Z95, two_sided_p
from eventide.plans.scan import right_size

DISTS = ("weibull", "lognormal", "loglogistic")
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _norm_logsf(z):
    # log(1 - Phi(z)) accurately in both tails
    v = np.asarray(_erfc(z / math.sqrt(2.0)), dtype=float) / 2.0
    return np.log(np.maximum(v, 1e-300))


def _parts(dist: str, z: np.ndarray):
    """log density A(z), log survival B(z) of the standard error and their derivatives."""
    if dist == "weibull":
        ez = np.exp(z)
        return z - ez, -ez, 1 - ez, -ez, -ez, -ez
    if dist == "loglogistic":
        sg = 0.5 * (1.0 + np.tanh(0.5 * z))
        l1p = np.logaddexp(0.0, z)
        return z - 2 * l1p, -l1p, 1 - 2 * sg, -2 * sg * (1 - sg), -sg, -sg * (1 - sg)
    logsf = _norm_logsf(z)
    lam = np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - logsf)  # inverse Mills ratio
    return -0.5 * math.log(2 * math.pi) - 0.5 * z * z, logsf, -z, -np.ones_like(z), -lam, -lam * (lam - z)


def _batch_stats(pdf: pd.DataFrame, theta: np.ndarray, p: int, dist: str) -> dict:
    X = np.column_stack([np.ones(len(pdf))] + [pdf[f"x{j}"].to_numpy() for j in range(p)])
    lt = np.log(pdf["t"].to_numpy())
    E = pdf["e"].to_numpy().astype(float)
    b, s = theta[:-1], theta[-1]
    sig = math.exp(s)
    z = (lt - X @ b) / sig
    A, B, A1, A2, B1, B2 = _parts(dist, z)
    ll = E * (-s - lt + A) + (1 - E) * B
    h = E * A1 + (1 - E) * B1
    h1 = E * A2 + (1 - E) * B2
    d_eta = -h / sig
    d_s = -E - z * h
    d_ee = h1 / sig ** 2
    d_es = (h + z * h1) / sig
    d_ss = z * h + z * z * h1
    q = p + 1
    g = np.concatenate([X.T @ d_eta, [d_s.sum()]])
    H = np.zeros((q + 1, q + 1))
    H[:q, :q] = (X * d_ee[:, None]).T @ X
    H[:q, q] = H[q, :q] = X.T @ d_es
    H[q, q] = d_ss.sum()
    return {"ll": float(ll.sum()), "g": g, "H": H}


def _stats(X: DataFrame, theta: np.ndarray, p: int, dist: str):
    q = p + 2

    def fn(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            r = _batch_stats(pdf, theta, p, dist)
            yield pd.DataFrame({"ll": [r["ll"]], "g": [r["g"].tolist()], "H": [r["H"].reshape(-1).tolist()]})

    part = X.mapInPandas(fn, "ll double, g array<double>, H array<double>")
    n2 = q * q
    agg = part.agg(F.sum("ll").alias("ll"),
                   *[F.sum(F.col("g")[i]).alias(f"g{i}") for i in range(q)],
                   *[F.sum(F.col("H")[i]).alias(f"H{i}") for i in range(n2)]).first()
    # a step too far can overflow to NaN, which Arrow hands back as null: the worst likelihood
    num = lambda v, other: other if v is None or not math.isfinite(v) else float(v)
    g = np.array([num(agg[f"g{i}"], 0.0) for i in range(q)])
    H = np.array([num(agg[f"H{i}"], 0.0) for i in range(n2)]).reshape(q, q)
    return num(agg["ll"], -math.inf), g, H


@dataclass
class AFTModel:
    dist: str
    features: list[str]
    intercept: float
    coef: np.ndarray
    log_sigma: float
    variance: np.ndarray  # (p+2) x (p+2) for (b0, b, log sigma)
    loglik: float
    n: int
    events: float
    iterations: int
    concordance: float = float("nan")

    @property
    def sigma(self):
        return math.exp(self.log_sigma)

    def coefficients(self, spark) -> DataFrame:
        names = ["intercept"] + self.features + ["log_sigma"]
        vals = [self.intercept] + list(self.coef) + [self.log_sigma]
        se = np.sqrt(np.maximum(np.diag(self.variance), 0.0))
        rows = []
        for nme, v, s in zip(names, vals, se):
            z = v / s if s > 0 else float("nan")
            rows.append((nme, float(v), float(s), float(z), float(two_sided_p(z)), float(v - Z95 * s),
                         float(v + Z95 * s)))
        return spark.createDataFrame(rows, "parameter string, coef double, se double, z double, "
                                           "p_value double, ci_lower double, ci_upper double")

    def importance(self, spark) -> DataFrame:
        """importance = -coef (longer time = lower risk), CI flipped."""
        c = self.coefficients(spark).where(F.col("parameter").isin(self.features))
        return c.select(F.col("parameter").alias("feature"), (-F.col("coef")).alias("importance"),
                        "p_value", (-F.col("ci_upper")).alias("ci_lower"), (-F.col("ci_lower")).alias("ci_upper"))

    def summary(self) -> dict:
        k = len(self.features) + 2
        return {"dist": self.dist, "n": self.n, "events": self.events, "log_likelihood": self.loglik,
                "aic": 2 * k - 2 * self.loglik, "concordance": self.concordance, "iterations": self.iterations}

    def eta(self) -> F.Column:
        e = F.lit(float(self.intercept))
        for j, f in enumerate(self.features):
            e = e + F.col(f).cast("double") * float(self.coef[j])
        return e

    def predict(self, df: DataFrame) -> DataFrame:
        """median time and risk = -median."""
        off = {"weibull": math.log(math.log(2.0)), "lognormal": 0.0, "loglogistic": 0.0}[self.dist]
        med = F.exp(self.eta() + self.sigma * off)
        return df.withColumn("median_time", med).withColumn("risk", -F.col("median_time"))

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """S(t|x) at requested times with a 95 % delta-method interval on the standardised
        residual z = (log t - eta)/sigma (S is monotone in z); log-normal via a pandas UDF for erfc."""
        grid = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("time")
        p = len(self.features)
        x = df.select(*keep, self.eta().alias("_eta"), *[F.col(f).cast("double").alias(f"_x{j}")
                                                         for j, f in enumerate(self.features)], grid)
        z = (F.log("time") - F.col("_eta")) / self.sigma
        x = x.withColumn("_z", z)
        # gradient of z w.r.t. (b0, b, log sigma): (-1, -x, -z*sigma) / sigma ... times sigma folded in
        g = [F.lit(-1.0 / self.sigma)] + [-F.col(f"_x{j}") / self.sigma for j in range(p)] + [-F.col("_z")]
        V = self.variance
        var = F.lit(0.0)
        for a in range(p + 2):
            for b in range(p + 2):
                if V[a, b] != 0.0:
                    var = var + g[a] * g[b] * float(V[a, b])
        x = x.withColumn("_se", F.sqrt(F.greatest(var, F.lit(0.0))))

        def sf(col):
            if self.dist == "weibull":
                return F.exp(-F.exp(col))
            if self.dist == "loglogistic":
                return 1.0 / (1.0 + F.exp(col))

            @F.pandas_udf("double")
            def norm_sf(v: pd.Series) -> pd.Series:
                return pd.Series(np.exp(_norm_logsf(v.to_numpy())))
            return norm_sf(col)

        return x.select(*keep, "time", sf(F.col("_z")).alias("survival"),
                        sf(F.col("_z") + Z95 * F.col("_se")).alias("ci_lower"),
                        sf(F.col("_z") - Z95 * F.col("_se")).alias("ci_upper"))


def aft_fit(df: DataFrame, time: str, event: str, features: Sequence[str], dist: str = "weibull",
            penalizer: float = 0.0, max_iter: int = 50, tol: float = 1e-10,
            with_concordance: bool = True, l1_ratio: float = 0.0) -> AFTModel:
    """Maximum likelihood AFT; optional elastic-net penalty on the covariate coefficients
    (``l1_ratio`` of it as a smoothed absolute value, the rest as squares)."""
    if dist not in DISTS:
        raise ValueError(f"dist must be one of {DISTS}")
    feats = list(features)
    p = len(feats)
    X = right_size(df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                             *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(feats)])) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    st = X.agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("ev"), F.avg(F.log("t")).alias("m"),
               F.stddev_pop(F.log("t")).alias("s")).first()
    n = int(st["n"])
    theta = np.zeros(p + 2)
    theta[0] = st["m"]
    theta[-1] = math.log(st["s"] or 1.0)

    def objective(th):
        ll, g, H = _stats(X, th, p, dist)
        pen, pg, ph = _penalty(th[1:p + 1], penalizer, l1_ratio, n)
        gp, Hp = g.copy(), H.copy()
        gp[1:p + 1] -= pg
        Hp[1:p + 1, 1:p + 1] -= ph
        return ll - pen, ll, gp, Hp

    obj, ll, g, H = objective(theta)
    it = 0
    for it in range(1, max_iter + 1):
        # Newton step on -H; damped (Levenberg) while -H is not positive definite
        negH = -H
        mu = 0.0
        for _ in range(60):
            try:
                np.linalg.cholesky(negH + mu * np.eye(len(g)))
                break
            except np.linalg.LinAlgError:
                mu = max(2 * mu, 1e-6 * max(1.0, float(np.abs(np.diag(negH)).max())))
        step = np.linalg.solve(negH + mu * np.eye(len(g)), g)
        shrink, ok = 1.0, False
        for _ in range(30):
            cand = theta + shrink * step
            o2, l2, g2, H2 = objective(cand)
            if np.isfinite(o2) and o2 >= obj - 1e-12 * abs(obj):
                ok = True
                break
            shrink *= 0.5
        if not ok:
            break
        imp = o2 - obj
        theta, obj, ll, g, H = cand, o2, l2, g2, H2
        if abs(imp) <= tol * max(1.0, abs(obj)):
            break
    cov = np.linalg.inv(-H)
    m = AFTModel(dist, feats, float(theta[0]), theta[1:p + 1], float(theta[-1]), cov, ll, n,
                 float(st["ev"] or 0.0), it)
    if with_concordance:
        from eventide.operators.concordance import concordance
        scored = m.predict(X.select("t", "e", *[F.col(f"x{j}").alias(f) for j, f in enumerate(feats)]))
        m.concordance = concordance(scored, "t", "e", "risk")["c_index"]
    X.unpersist()
    return m
