"""Bayesian parametric survival by Markov chains over full-data likelihoods.

Every likelihood is a sum over all rows that Spark makes: a pass evaluates many parameter vectors
at once and returns one partial sum per partition.  Newton steps on such sums find the posterior
mode and its curvature; the chains are independence Metropolis samplers whose proposals come from a
heavy-tailed normal around the mode and whose posterior values, for all proposals of all chains, are
summed in one further pass.  The result does not depend on how rows are partitioned or on how many
there are.  WAIC comes from per-row log-likelihoods over the draws, summed in Spark.

Models (one parameterisation throughout):
  weibull      S(t|x) = exp(-lambda e^{x b} t^alpha),   theta = (log lambda, log alpha, b)
  exponential  alpha = 1,                               theta = (log lambda, b)
  lognormal    log T = mu + x b + sigma N(0,1),         theta = (mu, log sigma, b)
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.special import erfc
from eventide.plans.scan import right_size

#: Rows that a task evaluates at a time (times the number of parameter vectors).
CHUNK_ROWS = 500
#: Degrees of freedom of the proposals.
PROPOSAL_DF = 5.0
#: Numbers of one matrix (rows x parameter vectors) in a task, so that it stays in the processor's cache.
CHUNK_CELLS = 32_768


def _norm_logsf(z):
    return np.log(np.maximum(erfc(np.asarray(z, float) / math.sqrt(2.0)) / 2.0, 1e-300))


def loglik_rows(theta: np.ndarray, t: np.ndarray, e: np.ndarray, X: np.ndarray, dist: str) -> np.ndarray:
    """Per-row log-likelihood; theta may be (d,) or (G, d) -> (n,) or (n, G)."""
    th = np.atleast_2d(theta)
    lt = np.log(t)[:, None]
    e = e[:, None]
    if dist in ("weibull", "exponential"):
        la = th[:, 0][None, :]
        if dist == "weibull":
            a = th[:, 1][None, :]
            b = th[:, 2:]
        else:
            a = np.zeros_like(la)
            b = th[:, 1:]
        eta = X @ b.T if b.shape[1] else np.zeros((len(t), th.shape[0]))
        alpha = np.exp(a)
        out = la + eta + alpha * lt  # log of the cumulative hazard
        H = np.exp(out)
        out += a - lt
        out *= e
        out -= H
    else:
        mu = th[:, 0][None, :]
        ls = th[:, 1][None, :]
        b = th[:, 2:]
        eta = X @ b.T if b.shape[1] else np.zeros((len(t), th.shape[0]))
        z = (lt - mu - eta) / np.exp(ls)
        out = e * (-ls - lt - 0.5 * math.log(2 * math.pi) - 0.5 * z * z)
        open_ = e[:, 0] < 1
        out[open_] += (1 - e[open_]) * _norm_logsf(z[open_])
    return out[:, 0] if np.ndim(theta) == 1 else out


def _n_base(dist):
    return 1 if dist == "exponential" else 2


def loglik_sums(theta: np.ndarray, t: np.ndarray, e: np.ndarray, X: np.ndarray, dist: str) -> np.ndarray:
    """Column sums of ``loglik_rows`` for theta (G, d) -> (G,).

    The events' share is linear (proportional hazards) or quadratic (log-normal) in a row's (1, log t, x), so it comes
    from the sums of those; only the cumulative hazards, or the censored rows' tails, need rows x parameter vectors.
    """
    V = np.column_stack([np.ones(len(t)), np.log(t), X])
    nb = _n_base(dist)
    b = theta[:, nb:].T
    if dist == "lognormal":
        ls = theta[:, 1]
        U = np.concatenate([-theta[:, :1].T, np.ones((1, len(theta))), -b]) / np.exp(ls)  # z = V U
        Q = (V * e[:, None]).T @ V
        out = -Q[0, 0] * (ls + 0.5 * math.log(2 * math.pi)) - Q[0, 1] - 0.5 * (U * (Q @ U)).sum(axis=0)
        rows = e < 1
        V, weight = V[rows], 1.0 - e[rows]
    else:
        la, a = theta[:, 0], theta[:, 1] if dist == "weibull" else np.zeros(len(theta))
        alpha = np.exp(a)
        out = (e @ V) @ np.concatenate([[la + a, alpha - 1.0], b])
        U = np.concatenate([[la, alpha], b])  # log of the cumulative hazard = V U
    each = max(1, CHUNK_CELLS // max(1, len(V)))
    for k in range(0, len(theta) if len(V) else 0, each):
        z = V @ U[:, k:k + each]
        if dist == "lognormal":
            out[k:k + each] += weight @ _norm_logsf(z)
        else:
            out[k:k + each] -= np.exp(z, out=z).sum(axis=0)
    return out


def _sums(x: DataFrame, thetas: np.ndarray, p: int, dist: str) -> np.ndarray:
    """Log-likelihood of all rows at every row of ``thetas``; one partial sum per partition is collected."""
    shared = x.sparkSession.sparkContext.broadcast(thetas)  # parameter vectors only

    def fn(it):
        th, total = shared.value, np.zeros(len(shared.value))
        for pdf in it:
            t, e = pdf["t"].to_numpy(float), pdf["e"].to_numpy(float)
            X = np.column_stack([pdf[f"x{j}"].to_numpy(float) for j in range(p)]) if p else np.zeros((len(t), 0))
            for a in range(0, len(t), CHUNK_ROWS):
                z = slice(a, a + CHUNK_ROWS)
                with np.errstate(over="ignore", invalid="ignore"):
                    total += np.nan_to_num(loglik_sums(th, t[z], e[z], X[z], dist), nan=-1e300, neginf=-1e300)
        yield pd.DataFrame({"s": [total.tolist()]})

    parts = x.mapInPandas(fn, "s array<double>").collect()
    return np.sum([r["s"] for r in parts], axis=0) if parts else np.zeros(len(thetas))


def _mode(posterior, th: np.ndarray, max_iter: int = 50, h: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mode and covariance by damped Newton; derivatives by central differences, all the
    points of a step in one pass."""
    d = len(th)
    unit = np.eye(d) * h
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    for _ in range(max_iter):
        points = [th] + [th + s * unit[i] for i in range(d) for s in (1, -1)]
        points += [th + s * unit[i] + r * unit[j] for i, j in pairs for s in (1, -1) for r in (1, -1)]
        f = posterior(np.array(points))
        up, down = f[1:2 * d + 1:2], f[2:2 * d + 1:2]
        g, H = (up - down) / (2 * h), np.diag((up - 2 * f[0] + down) / h**2)
        for k, (i, j) in enumerate(pairs):
            pp, pm, mp, mm = f[2 * d + 1 + 4 * k:2 * d + 5 + 4 * k]
            H[i, j] = H[j, i] = (pp - pm - mp + mm) / (4 * h * h)
        values, vectors = np.linalg.eigh(-H)
        values = np.maximum(np.abs(values), 1e-9 * max(1.0, np.abs(values).max()))
        cov = (vectors / values) @ vectors.T
        step = cov @ g
        tries = np.array([th + 0.5**k * step for k in range(24)])
        better = np.flatnonzero(posterior(tries) >= f[0] - 1e-9 * abs(f[0]))
        if not len(better):
            break
        move = 0.5**better[0] * step
        th = th + move
        if np.abs(move).max() < 1e-6:
            break
    return th, cov


def _chains(posterior, mode: np.ndarray, cov: np.ndarray, draws: int, chains: int, tune: int, seed: int) -> np.ndarray:
    """Independence Metropolis chains (draws after ``tune`` steps), proposals from a multivariate t."""
    d = len(mode)
    root = np.linalg.cholesky(cov + 1e-12 * np.eye(d) * np.trace(cov) / d)
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(chains, tune + draws, d)) * np.sqrt(PROPOSAL_DF / rng.chisquare(PROPOSAL_DF, size=(chains, tune + draws, 1)))
    z[:, 0] = 0.0  # chains begin at the mode
    points = mode + z @ root.T
    density = -0.5 * (PROPOSAL_DF + d) * np.log1p((z**2).sum(axis=2) / PROPOSAL_DF)
    weight = posterior(points.reshape(-1, d)).reshape(chains, -1) - density
    out, u = [], np.log(rng.random((chains, tune + draws)))
    for c in range(chains):
        at = 0
        for k in range(tune + draws):
            if u[c, k] < weight[c, k] - weight[c, at]:
                at = k
            if k >= tune:
                out.append(points[c, at])
    return np.array(out)


@dataclass
class BayesModel:
    dist: str
    features: list[str]
    names: list[str]
    draws: np.ndarray  # (G, d) on the original covariate scale
    shards: int = 1  # kept for stored models
    waic: float = float("nan")
    p_waic: float = float("nan")
    max_time: float = 1.0
    extra: dict = field(default_factory=dict)

    def summary_table(self, spark) -> DataFrame:
        rows = []
        nb = _n_base(self.dist)
        for j, nme in enumerate(self.names):
            v = self.draws[:, j]
            q = np.percentile(v, [2.5, 97.5])
            hr = float(np.exp(v).mean()) if j >= nb else None
            rows.append((nme, float(v.mean()), float(v.std(ddof=1)), float(q[0]), float(q[1]),
                         float((v > 0).mean()), hr))
        return spark.createDataFrame(rows, "parameter string, mean double, std double, q025 double, q975 double, "
                                           "prob_positive double, ratio_mean double")

    def summary(self) -> dict:
        return {"dist": self.dist, "draws": int(self.draws.shape[0]), "shards": self.shards,
                "waic": self.waic, "p_waic": self.p_waic, **self.extra}

    def importance(self, spark) -> DataFrame:
        nb = _n_base(self.dist)
        return spark.createDataFrame([(f, float(abs(self.draws[:, nb + j].mean()))) for j, f in
                                      enumerate(self.features)], "feature string, importance double")

    def _surv_mean_cov(self, grid: np.ndarray) -> np.ndarray:
        th = self.draws
        nb = _n_base(self.dist)
        return _surv(th, grid, np.zeros((1, th.shape[1] - nb)), self.dist)[0]  # (G, T) at x = 0

    def curve_bands(self, spark, n: int = 100) -> DataFrame:
        """Posterior S(t) at zero covariates on n points to 1.2 max T: mean and 95 % band."""
        grid = np.linspace(1.2 * self.max_time / n, 1.2 * self.max_time, n)
        S = self._surv_mean_cov(grid)
        q = np.percentile(S, [2.5, 50, 97.5], axis=0)
        rows = [(float(grid[i]), float(S[:, i].mean()), float(q[0, i]), float(q[1, i]), float(q[2, i]))
                for i in range(n)]
        return spark.createDataFrame(rows, "time double, survival double, lower double, median double, upper double")

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Posterior-mean linear predictor; risk = hazard ratio (PH) or -median time (log-normal)."""
        nb = _n_base(self.dist)
        mean = self.draws.mean(axis=0)
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + F.col(f).cast("double") * float(mean[nb + j])
        x = df.select(*keep, lp.alias("f"))
        if self.dist == "lognormal":
            return x.withColumn("risk", -F.exp(F.lit(float(mean[0])) + F.col("f")))
        return x.withColumn("risk", F.exp("f"))

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """Posterior mean S(t|x) over all draws at the requested times."""
        th = self.draws
        feats, dist, keep = list(self.features), self.dist, list(keep)
        grid = np.array(times, float)
        spark = df.sparkSession
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        schema = (schema + ", " if schema else "") + "time double, survival double"
        bth = spark.sparkContext.broadcast(th)

        def fn(it):
            th_ = bth.value
            for pdf in it:
                X = np.column_stack([pdf[f].to_numpy(float) for f in feats]) if feats else np.zeros((len(pdf), 0))
                S = np.concatenate([_surv(th_, grid, X[a:a + 50], dist).mean(axis=1) for a in range(0, len(X), 50)] or
                                   [np.zeros((0, len(grid)))])  # (n, T)
                out = pdf[keep].loc[pdf.index.repeat(len(grid))].reset_index(drop=True)
                out["time"] = np.tile(grid, len(pdf))
                out["survival"] = S.reshape(-1)
                yield out

        return df.select(*keep, *[f for f in feats if f not in keep]).mapInPandas(fn, schema)


    def survival_at(self, df: DataFrame, times: str, keep: Sequence[str]) -> DataFrame:
        """keep..., _s: posterior mean S at each row's own times, an array column (rows of one batch need not agree)."""
        feats, dist, keep = list(self.features), self.dist, list(keep)
        shared = df.sparkSession.sparkContext.broadcast(self.draws)
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

        def fn(it):
            th = shared.value
            for pdf in it:
                X = pdf[feats].to_numpy(float).reshape(len(pdf), len(feats))
                pdf = pdf.assign(_s=[_surv(th, np.asarray(t, float), X[i:i + 1], dist)[0].mean(axis=0) for i, t in enumerate(pdf[times])])
                yield pdf[[*keep, "_s"]]

        return df.select(*keep, times, *[f for f in feats if f not in keep]).mapInPandas(fn, f"{schema}, _s array<double>")


def _surv(th: np.ndarray, grid: np.ndarray, X: np.ndarray, dist: str) -> np.ndarray:
    """S for rows x draws x times -> (n, G, T)."""
    nb = _n_base(dist)
    b = th[:, nb:]
    eta = X @ b.T if b.shape[1] else np.zeros((X.shape[0], th.shape[0]))
    lt = np.log(grid)[None, None, :]
    if dist == "lognormal":
        z = (lt - th[:, 0][None, :, None] - eta[:, :, None]) / np.exp(th[:, 1])[None, :, None]
        return np.exp(_norm_logsf(z))
    alpha = np.exp(th[:, 1]) if dist == "weibull" else np.ones(th.shape[0])
    H = np.exp(th[:, 0][None, :, None] + eta[:, :, None] + alpha[None, :, None] * lt)
    return np.exp(-H)


def bayes_fit(df: DataFrame, time: str, event: str, features: Sequence[str], id_col: str = "id",
              dist: str = "weibull", prior_sigma: float = 2.0, draws: int = 1000, chains: int = 2,
              tune: int = 1000, seed: int = 42, with_waic: bool = True) -> BayesModel:
    """Posterior draws of a parametric model; ``chains`` x ``draws`` of them after ``tune`` steps."""
    if dist not in ("weibull", "exponential", "lognormal"):
        raise ValueError("dist must be weibull, exponential or lognormal")
    feats = list(features)
    p = len(feats)
    st = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.col(time).cast("double")).alias("mx"),
                *[F.avg(F.col(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{j}") for j, f in enumerate(feats)]).first()
    means = np.array([st[f"m{j}"] or 0.0 for j in range(p)])
    scales = np.array([st[f"s{j}"] or 1.0 for j in range(p)])
    scales = np.where(scales > 0, scales, 1.0)
    x = right_size(df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                             *[((F.col(f).cast("double") - float(means[j])) / float(scales[j])).alias(f"x{j}")
                               for j, f in enumerate(feats)])).persist(StorageLevel.MEMORY_AND_DISK)
    start = np.zeros(_n_base(dist) + p)
    first = x.agg(F.avg(F.log("t")).alias("m"), F.stddev_pop(F.log("t")).alias("s"), F.sum("e").alias("e"), F.sum("t").alias("t")).first()
    if dist == "lognormal":
        start[0], start[1] = first["m"], math.log(max(first["s"] or 0.0, 1e-3))
    else:
        start[0] = math.log(max(first["e"], 1.0) / first["t"])

    def posterior(thetas):
        return _sums(x, thetas, p, dist) - 0.5 * (thetas**2).sum(axis=1) / prior_sigma**2
    mode, cov = _mode(posterior, start)
    comb = _chains(posterior, mode, cov, draws, chains, tune, seed)
    x.unpersist()
    # back to the original covariate scale
    nb = _n_base(dist)
    orig = comb.copy()
    if p:
        orig[:, nb:] = comb[:, nb:] / scales
        orig[:, 0] = comb[:, 0] - orig[:, nb:] @ means
    base_names = {"weibull": ["log_lambda", "log_alpha"], "exponential": ["log_lambda"],
                  "lognormal": ["mu", "log_sigma"]}[dist]
    m = BayesModel(dist, feats, base_names + feats, orig, max_time=float(st["mx"]))
    if dist == "lognormal":
        med = np.exp(orig[:, 0] - (orig[:, nb:] @ means if p else 0.0))
    else:
        alpha = np.exp(orig[:, 1]) if dist == "weibull" else np.ones(len(orig))
        med = (math.log(2.0) / np.exp(orig[:, 0] + (orig[:, nb:] @ means if p else 0.0))) ** (1.0 / alpha)
    m.extra = {"median_time_at_mean": float(np.mean(med)),
               "median_time_q025": float(np.percentile(med, 2.5)),
               "median_time_q975": float(np.percentile(med, 97.5))}
    if with_waic:
        m.waic, m.p_waic = _waic(df, time, event, feats, orig, dist)
    return m


def _waic(df, time, event, feats, draws, dist, chunk: int | None = None):
    chunk = chunk or max(1, CHUNK_CELLS // len(draws))
    bth = df.sparkSession.sparkContext.broadcast(draws)

    def fn(it):
        th_ = bth.value
        lppd = pw = 0.0
        for pdf in it:
            for s in range(0, len(pdf), chunk):
                part = pdf.iloc[s:s + chunk]
                X = np.column_stack([part[f].to_numpy(float) for f in feats]) if feats else np.zeros((len(part), 0))
                L = loglik_rows(th_, part[time].to_numpy(float), part[event].to_numpy(float), X, dist)
                mx = L.max(axis=1, keepdims=True)
                lppd += float((mx[:, 0] + np.log(np.exp(L - mx).mean(axis=1))).sum())
                pw += float(L.var(axis=1, ddof=1).sum())
        yield pd.DataFrame({"lppd": [lppd], "pw": [pw]})

    x = df.select(F.col(time).cast("double").alias(time), F.col(event).cast("double").alias(event),
                  *[F.col(f).cast("double") for f in feats])
    r = x.mapInPandas(fn, "lppd double, pw double").agg(F.sum("lppd").alias("a"), F.sum("pw").alias("b")).first()
    return -2.0 * (r["a"] - r["b"]), float(r["b"])
