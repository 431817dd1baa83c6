"""Cox proportional hazards by distributed Newton-Raphson.

One Newton step never builds a (rows x p^2) table.  With w = exp(x.b) and,
per distinct time u, reverse running sums S0 = sum w, S1 = sum w x over the
risk set and tied-event sums D0, D1, the Efron terms z_l = S0 - (l/d) D0
(l = 0..d-1; Breslow drops the l/d part) give per time

    a(u) = sum_l 1/z_l,   c(u) = sum_l (l/d)/z_l,   A(t) = sum_{u<=t} a(u)

and per row s_i = w_i (A(T_i) - E_i c(T_i)).  Then

    gradient    = sum_i x_i (E_i - s_i)
    information = sum_i s_i x_i x_i' - sum_u sum_l m_l m_l',  m_l = (S1 - (l/d) D1)/z_l

where the last sum needs only three scalars per time (q0, q1, q2).  So a step
is one grouped time table, one running-sum scan (``scan.cumulative``), a join
of (A, c) back to the rows and one p x p aggregate.  Where few times are
distinct (``TIED_CELLS``) the time table also holds the sums of w x x' per time
and event, and a step reads the rows only once (``_tied_stats``).  Only p-vectors
and p x p matrices reach the driver.  Covariates are centred and scaled inside
the fit; coefficients are reported on the original scale.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.stats import Z95, chi2_sf, two_sided_p
from eventide.functions.sums import KeyedSums, columns
from eventide.plans.scan import SINGLE_WINDOW_MAX_ROWS, cumulative, right_size

# Efron sums loop over l = 0..d-1 inside one row when d is at most this;
# larger tie groups are cut into chunks of this size first.
EFRON_CHUNK = 100_000
BROADCAST_TIMES = 1_000_000
# A step reads the rows once if the time table with its p x p sums has at most this many numbers.
TIED_CELLS = 4_000_000
# Rows that a task of such a step sorts at a time.
TIED_ROWS = 50_000
L1_SMOOTH = 1e-8


@dataclass
class CoxModel:
    features: list[str]
    coef: np.ndarray
    means: np.ndarray
    variance: np.ndarray
    loglik: float
    loglik_null: float
    n: int
    events: float
    iterations: int
    ties: str
    penalizer: float
    l1_ratio: float
    baseline: DataFrame = field(repr=False, default=None)  # time, baseline_hazard, baseline_survival
    concordance: float = float("nan")
    offset: str | None = None

    # ---- summaries -------------------------------------------------------
    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.variance), 0.0))

    def coefficients(self, spark) -> DataFrame:
        """Feature, coef, se, z, p, hazard ratio and 95 % CI."""
        rows = []
        for j, f in enumerate(self.features):
            b, s = float(self.coef[j]), float(self.se[j])
            z = b / s if s > 0 else float("nan")
            rows.append((f, b, s, z, two_sided_p(z), math.exp(b), b - Z95 * s, b + Z95 * s,
                         math.exp(b - Z95 * s), math.exp(b + Z95 * s)))
        return spark.createDataFrame(rows, "feature string, coef double, se double, z double, "
                                           "p_value double, hazard_ratio double, ci_lower double, "
                                           "ci_upper double, hr_lower double, hr_upper double")

    def importance(self, spark) -> DataFrame:
        """|coef| descending with p-value and CI."""
        c = self.coefficients(spark)
        return c.select("feature", F.abs("coef").alias("importance"), "coef", "p_value",
                        "ci_lower", "ci_upper").orderBy(F.col("importance").desc(), "feature")

    def summary(self) -> dict:
        """Log-likelihood, AIC, BIC, likelihood-ratio test, concordance."""
        p = len(self.features)
        lr = 2.0 * (self.loglik - self.loglik_null)
        return {"n": self.n, "events": self.events, "log_likelihood": self.loglik,
                "log_likelihood_null": self.loglik_null, "aic_partial": -2 * self.loglik + 2 * p,
                "bic_partial": -2 * self.loglik + p * math.log(max(self.events, 1.0)),
                "lr_statistic": lr, "lr_df": p, "lr_p_value": chi2_sf(lr, p),
                "concordance": self.concordance, "iterations": self.iterations, "ties": self.ties}

    # ---- prediction ------------------------------------------------------
    def linear_predictor(self, df: DataFrame, include_offset: bool = True) -> F.Column:
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + (F.col(f).cast("double") - F.lit(float(self.means[j]))) * F.lit(float(self.coef[j]))
        if self.offset and include_offset:
            lp = lp + F.col(self.offset)
        return lp

    def predict_risk(self, df: DataFrame) -> DataFrame:
        """Partial hazard exp((x - mean) b) as ``risk``."""
        return df.withColumn("linear_predictor", self.linear_predictor(df)) \
                 .withColumn("risk", F.exp("linear_predictor"))

    def baseline_at(self, times: Sequence[float]) -> list[float]:
        """Cumulative baseline hazard at given times (one small aggregate)."""
        aggs = [F.max(F.when(F.col("time") <= float(t), F.col("baseline_hazard"))).alias(f"h{i}")
                for i, t in enumerate(times)]
        row = self.baseline.agg(*aggs).first()
        return [float(row[f"h{i}"] or 0.0) for i in range(len(times))]

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """Long table (keep..., time, survival) only for the requested times."""
        h = self.baseline_at(times)
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(v).alias("h0"))
                                   for t, v in zip(times, h)]))
        r = self.predict_risk(df).select(*keep, "risk", grid.alias("g"))
        return r.select(*keep, F.col("g.time").alias("time"),
                        F.exp(-F.col("g.h0") * F.col("risk")).alias("survival"))

    def predict_median(self, df: DataFrame, key: str) -> DataFrame:
        """First time with S(t|x) <= 0.5, i.e. H0(t) >= ln 2 / risk; +inf if never."""
        return median_from_baseline(self.baseline, self.predict_risk(df).select(key, "risk"), key)


def median_from_baseline(baseline: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """(key, median_time) for proportional hazards: the first baseline time with H0(t) * risk >= ln 2,
    found by an as-of lookup over all baseline times; +inf if there is none."""
    from eventide.operators.lookup import step_lookup
    pts = scored.select(key, (-F.lit(math.log(2.0)) / F.col("risk")).alias("nh"))
    curve = baseline.select((-F.col("baseline_hazard")).alias("nh"), F.col("time").alias("mt"))
    # several times can share one H0 value: keep the earliest
    curve = curve.groupBy("nh").agg(F.min("mt").alias("mt"))
    out = step_lookup(curve, pts, [], "nh", ["mt"])
    return out.select(key, F.coalesce(F.col("mt"), F.lit(float("inf"))).alias("median_time"))


def _efron_terms(tt: DataFrame, p: int, ties: str, max_d: int) -> DataFrame:
    """Per event time: a, c, L = sum log z, q0, q1, q2."""
    S0, D0, d = F.col("S0"), F.col("D0"), F.col("d").cast("double")
    if ties == "breslow":
        has = F.col("d") > 0
        return tt.select("*", (d / S0).alias("a"), F.lit(0.0).alias("c"),
                         F.when(has, d * F.log(S0)).otherwise(0.0).alias("L"),
                         (d / (S0 * S0)).alias("q0"), F.lit(0.0).alias("q1"), F.lit(0.0).alias("q2"))

    def acc_merge(acc, l):
        f = l.cast("double") / d
        z = S0 - f * D0
        return F.struct((acc["a"] + 1.0 / z).alias("a"), (acc["c"] + f / z).alias("c"),
                        (acc["L"] + F.log(z)).alias("L"), (acc["q0"] + 1.0 / (z * z)).alias("q0"),
                        (acc["q1"] + f / (z * z)).alias("q1"), (acc["q2"] + f * f / (z * z)).alias("q2"))

    init = F.struct(*[F.lit(0.0).alias(k) for k in ("a", "c", "L", "q0", "q1", "q2")])
    if max_d <= EFRON_CHUNK:
        s = F.when(F.col("d") > 0, F.aggregate(F.sequence(F.lit(0), F.col("d").cast("int") - 1), init, acc_merge)) \
            .otherwise(init)
        return tt.withColumn("_ef", s).select("*", *[F.col("_ef")[k].alias(k)
                                                     for k in ("a", "c", "L", "q0", "q1", "q2")]).drop("_ef")
    # very large tie groups: chunk the l-range so no row builds a huge array
    ch = (tt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("d") - 1) / EFRON_CHUNK)
                                                    .cast("int"))))
          .withColumn("_lo", F.col("_k") * EFRON_CHUNK)
          .withColumn("_hi", F.least(F.col("_lo") + EFRON_CHUNK, F.col("d").cast("int")) - 1))
    ch = ch.withColumn("_ef", F.aggregate(F.sequence(F.col("_lo"), F.col("_hi")), init, acc_merge))
    sums = ch.where(F.col("d") > 0).groupBy("time").agg(
        *[F.sum(F.col("_ef")[k]).alias(k) for k in ("a", "c", "L", "q0", "q1", "q2")])
    return tt.join(sums, "time", "left").fillna(0.0, ["a", "c", "L", "q0", "q1", "q2"])


def _many(X: DataFrame) -> bool:
    """Whether a cached table has so many partitions that their sums are first added up in a few tasks
    (asked once per table: planning it is not free)."""
    if not hasattr(X, "_many_partitions"):
        X._many_partitions = X.rdd.getNumPartitions() > 64
    return X._many_partitions


def _sum_rows(parts: DataFrame, width: int, many: bool) -> np.ndarray:
    """Sum of the one-row-per-batch arrays ``v``."""
    def add(it):
        total = np.zeros(width)
        for pdf in it:
            if len(pdf):
                total += np.sum(np.stack(pdf["v"].to_numpy()), axis=0)
        yield pd.DataFrame({"v": [total]})
    if many:
        parts = parts.repartition(16).mapInPandas(add, "v array<double>")
    rows = parts.collect()  # a bounded number of rows of ``width`` numbers
    return np.sum([r["v"] for r in rows], axis=0) if rows else np.zeros(width)


def _efron_sums(S0: np.ndarray, D0: np.ndarray, d: np.ndarray, ties: str) -> tuple[np.ndarray, ...]:
    """``_efron_terms`` of a small time table in NumPy: a, c, L, q0, q1, q2."""
    a, c, L, q0, q1, q2 = np.zeros((6, len(d)))
    some = np.flatnonzero(d > 0)
    if ties == "breslow":
        a[some], q0[some], L[some] = d[some] / S0[some], d[some] / S0[some]**2, d[some] * np.log(S0[some])
        return a, c, L, q0, q1, q2
    for i in some:
        for low in range(0, int(d[i]), EFRON_CHUNK):
            f = np.arange(low, min(low + EFRON_CHUNK, int(d[i]))) / d[i]
            z = S0[i] - f * D0[i]
            r = 1.0 / z
            fr = f * r
            a[i], c[i], L[i] = a[i] + r.sum(), c[i] + fr.sum(), L[i] + np.log(z).sum()
            q0[i], q1[i], q2[i] = q0[i] + r @ r, q1[i] + fr @ r, q2[i] + fr @ fr
    return a, c, L, q0, q1, q2


def _tied_width(p: int) -> int:
    """Sums per time and event: rows, w, eta, w x, x and the upper triangle of w x x'."""
    return 3 + 2 * p + p * (p + 1) // 2


def _tied_stats(X: DataFrame, p: int, beta: np.ndarray, ties: str, offset: bool):
    """``_step_stats`` where few times are distinct: one pass over the rows.

    A task adds up its rows per (time, event).  With Q(u) the sum of w x x' at time u and QD(u) that of its events,
    sum_i s_i x_i x_i' = sum_u A(u) Q(u) - c(u) QD(u), and the same with x for the gradient, so nothing is joined back.
    What the tasks found is added up by time, then the small table (``TIED_CELLS``) is scanned in one task.
    """
    xs, beta = [f"x{j}" for j in range(p)], np.asarray(beta, float)
    cols, width = ["t", "e", *xs] + (["off"] if offset else []), _tied_width(p)
    ia, ib = np.triu_indices(p)
    schema = "time double, e double, v array<double>"

    def packed(got):
        keys, sums = got
        at = np.arange(0, sums.size + 1, width, dtype=np.int32)
        v = pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(sums.T).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), v], ["time", "e", "v"])

    def unpacked(batch):
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        return columns(batch, ["time", "e"]), v.reshape(batch.num_rows, width).T

    def chunk(m):
        """One chunk's sums; a product of two columns is added up before the next one is made."""
        order = np.lexsort((m[1], m[0]))
        m = m[:, order]
        keys, x = m[:2], m[2:2 + p]
        same = (keys[:, 1:] == keys[:, :-1]) | (np.isnan(keys[:, 1:]) & np.isnan(keys[:, :-1]))
        at = np.flatnonzero(np.concatenate([[True], ~same.all(axis=0)]))
        eta = beta @ x + (m[2 + p] if offset else 0.0)
        w = np.exp(eta)
        wx = w * x
        sums = np.empty((width, len(at)))
        for i, v in enumerate([np.ones(len(w)), w, eta, *wx, *x]):
            np.add.reduceat(v, at, out=sums[i])
        product = np.empty(len(w))
        for i, (j, k) in enumerate(zip(ia, ib, strict=True), 3 + 2 * p):
            np.add.reduceat(np.multiply(wx[j], x[k], out=product), at, out=sums[i])
        return keys[:, at], sums

    def by_time(it):
        total, held, rows = KeyedSums(max(1, TIED_CELLS // width), raw=True), [], 0
        for batch in it:
            if batch.num_rows:
                held.append(columns(batch, cols))
                rows += batch.num_rows
            if rows >= TIED_ROWS:
                got = total.add(*chunk(np.concatenate(held, axis=1)))
                held, rows = [], 0
                if got is not None:
                    yield packed(got)
        if rows:
            total.add(*chunk(np.concatenate(held, axis=1)), last=True)
        got = total.rest()
        if got is not None:
            yield packed(got)

    def merged(it):
        total = KeyedSums(max(1, TIED_CELLS // width), raw=True)
        for batch in it:
            got = total.add(*unpacked(batch))
            if got is not None:
                yield packed(got)
        got = total.rest()
        if got is not None:
            yield packed(got)

    def scanned(it):
        total = KeyedSums(2**62, raw=True)
        for batch in it:
            total.add(*unpacked(batch))
        got = total.rest()
        if got is None:
            return
        keys, v = got
        known = ~np.isnan(keys[0])  # a missing time comes before all others and has no row of its own in the sums
        order = np.argsort(known, kind="stable")
        t, e, v, known = keys[0][order], keys[1][order], v.T[order], known[order]
        at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) & known[1:]]))
        T, D = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * e[:, None], at, axis=0)
        S0, S1 = np.cumsum(T[::-1, 1])[::-1], np.cumsum(T[::-1, 3:3 + p], axis=0)[::-1]
        D0, D1 = D[:, 1], D[:, 3:3 + p]
        a, c, L, q0, q1, q2 = _efron_sums(S0, D0, D[:, 0], ties)
        A = np.cumsum(a)
        A, c = A[known[at]], c[known[at]]
        T, D = T[known[at]], D[known[at]]
        Q = A @ T[:, 3 + 2 * p:] - c @ D[:, 3 + 2 * p:]
        M = np.zeros((p, p))
        M[ia, ib] = M[ib, ia] = Q
        cross = (S1 * q1[:, None]).T @ D1
        M -= (S1 * q0[:, None]).T @ S1 - cross - cross.T + (D1 * q2[:, None]).T @ D1
        g = D[:, 3 + p:3 + 2 * p].sum(axis=0) - (A @ T[:, 3:3 + p] - c @ D[:, 3:3 + p])
        out = np.concatenate([[D[:, 2].sum() - L.sum()], g, M.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = X.select(*cols).mapInArrow(by_time, schema)
    parts = parts.repartition(X.sparkSession.sparkContext.defaultParallelism, "time").mapInArrow(merged, schema)
    rows = parts.repartition(1).mapInArrow(scanned, "v array<double>").collect()  # one row
    v = np.array(rows[0]["v"], float) if rows else np.zeros(1 + p + p * p)
    info = v[1 + p:].reshape(p, p)
    return v[0], v[1:1 + p], (info + info.T) / 2


def _step_stats(X: DataFrame, p: int, beta: np.ndarray, ties: str, two_level: bool, max_d: int,
                broadcast_times: bool, offset: bool, tied: bool = False):
    """Log partial likelihood, gradient and information at ``beta``.

    Sums over rows and over p x p products are made in NumPy per Arrow batch and added up by Spark, so
    no query grows with p squared and every step runs the same compiled JVM code (the coefficients
    travel with the tasks).
    """
    if tied:
        return _tied_stats(X, p, beta, ties, offset)
    xs, beta = [f"x{j}" for j in range(p)], np.asarray(beta, float)
    cols = ["t", "e", *xs] + (["off"] if offset else [])

    def linear(pdf):
        x = pdf[xs].to_numpy(float).reshape(len(pdf), p)
        return x, x @ beta + (pdf["off"].to_numpy(float) if offset else 0.0)

    names = ["d", "S0p", "D0"] + [f"S1p{j}" for j in range(p)] + [f"D1{j}" for j in range(p)]

    def by_time(it):
        for pdf in it:
            if not len(pdf):
                continue
            x, eta = linear(pdf)
            e, w = pdf["e"].to_numpy(float), np.exp(eta)
            sums = np.column_stack([e, w, e * w, w[:, None] * x, (e * w)[:, None] * x])
            t = pdf["t"].to_numpy(float)
            order = np.argsort(t, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
            yield pd.DataFrame(np.add.reduceat(sums[order], at, axis=0), columns=names).assign(time=t[order][at])

    tt = X.select(*cols).mapInPandas(by_time, ", ".join(f"{n} double" for n in [*names, "time"]))
    tt = tt.groupBy("time").agg(*[F.sum(n).alias(n) for n in names])
    tt = cumulative(tt, "time", [], sums={"S0": "S0p", **{f"S1{j}": f"S1p{j}" for j in range(p)}},
                    descending=True, force_two_level=two_level)
    # Efron terms for every time (zero where no event), then A(t) = running sum of a; the time
    # table is cached once and read by both aggregates of the step
    ev = _efron_terms(tt, p, ties, max_d)
    ev = cumulative(ev, "time", [], sums={"A": "a"}, force_two_level=two_level)
    ev = ev.persist(StorageLevel.MEMORY_AND_DISK)

    def over_times(it):
        for pdf in it:
            if not len(pdf):
                continue
            S1, D1 = (pdf[[f"{k}{j}" for j in range(p)]].to_numpy(float).reshape(len(pdf), p) for k in ("S1", "D1"))
            q0, q1, q2 = (pdf[k].to_numpy(float)[:, None] for k in ("q0", "q1", "q2"))
            cross = (S1 * q1).T @ D1
            M = (S1 * q0).T @ S1 - cross - cross.T + (D1 * q2).T @ D1
            yield pd.DataFrame({"v": [np.concatenate([[pdf["L"].sum()], M.ravel()])]})

    times = _sum_rows(ev.select("L", "q0", "q1", "q2", *[f"S1{j}" for j in range(p)], *[f"D1{j}" for j in range(p)])
                      .mapInPandas(over_times, "v array<double>"), 1 + p * p, _many(X))
    at = ev.select("time", "A", "c")
    at = F.broadcast(at) if broadcast_times else at

    def over_rows(it):
        for pdf in it:
            if not len(pdf):
                continue
            x, eta = linear(pdf)
            e = pdf["e"].to_numpy(float)
            s = np.exp(eta) * (pdf["A"].to_numpy(float) - e * pdf["c"].to_numpy(float))
            yield pd.DataFrame({"v": [np.concatenate([[(e * eta).sum()], x.T @ (e - s), ((x * s[:, None]).T @ x).ravel()])]})

    j = X.join(at, X["t"] == at["time"], "inner").select(*cols, "A", "c")
    rows = _sum_rows(j.mapInPandas(over_rows, "v array<double>"), 1 + p + p * p, _many(X))
    ev.unpersist()
    info = rows[1 + p:].reshape(p, p) - times[1:].reshape(p, p)
    return rows[0] - times[0], rows[1:1 + p], (info + info.T) / 2


def _penalty(beta, lam, alpha, n):
    l2 = 0.5 * (1 - alpha) * float(beta @ beta)
    sq = np.sqrt(beta * beta + L1_SMOOTH)
    l1 = alpha * float(sq.sum())
    val = n * lam * (l2 + l1)
    grad = n * lam * ((1 - alpha) * beta + alpha * beta / sq)
    hess = n * lam * ((1 - alpha) * np.eye(len(beta)) + alpha * np.diag(L1_SMOOTH / sq ** 3))
    return val, grad, hess


def cox_fit(df: DataFrame, time: str, event: str, features: Sequence[str], penalizer: float = 0.0,
            l1_ratio: float = 0.0, ties: str = "efron", offset: str | None = None,
            max_iter: int = 25, tol: float = 1e-9, with_concordance: bool = True,
            init: Sequence[float] | None = None) -> CoxModel:
    """Fit a Cox model.  Rows with null time/event/features must be removed first."""
    if ties not in ("efron", "breslow"):
        raise ValueError("ties must be 'efron' or 'breslow'")
    feats = list(features)
    rows = _standardised(df, time, event, feats, [F.col(offset).cast("double").alias("off")] if offset else [])
    X = right_size(rows.table, rows.n).persist(StorageLevel.MEMORY_AND_DISK)
    rows.times(X)
    model = _fit_standardised(X, rows, penalizer, l1_ratio, ties, offset, max_iter, tol, init)
    if with_concordance:
        from eventide.operators.concordance import concordance
        scored = X.withColumn("risk", _eta(len(feats), model.coef * rows.scales, bool(offset)))
        model.concordance = concordance(scored, "t", "e", "risk")["c_index"]
    X.unpersist()
    return model


@dataclass
class _Standardised:
    """Rows ready for Newton steps (t, e, x0.., kept columns) and what the steps need to know of them."""
    features: list[str]
    table: DataFrame
    n: int
    events: float
    means: np.ndarray
    scales: np.ndarray
    n_times: int = 0
    max_d: int = 0

    def times(self, X: DataFrame):
        """Counts the distinct times of the (cached) rows and the events of the fullest one."""
        tinfo = X.groupBy("t").agg(F.sum("e").alias("d")).agg(F.count(F.lit(1)).alias("nt"), F.max("d").alias("md")).first()
        self.n_times, self.max_d = int(tinfo["nt"]), int(tinfo["md"] or 0)


def _standardised(df: DataFrame, time: str, event: str, feats: list[str], keep: Sequence[F.Column] = ()) -> _Standardised:
    p = len(feats)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("double")).alias("ev"),
                   *[F.avg(F.col(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                   *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{j}") for j, f in enumerate(feats)],
                   ).first()
    means = np.array([stats[f"m{j}"] or 0.0 for j in range(p)])
    scales = np.array([stats[f"s{j}"] or 0.0 for j in range(p)])
    scales = np.where(scales > 0, scales, 1.0)
    cols = [F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e")]
    cols += [((F.col(f).cast("double") - F.lit(float(means[j]))) / F.lit(float(scales[j]))).alias(f"x{j}")
             for j, f in enumerate(feats)]
    table = df.select(*cols, *keep)
    return _Standardised(feats, table, int(stats["n"]), float(stats["ev"] or 0.0), means, scales)


def _fit_standardised(X: DataFrame, rows: _Standardised, penalizer: float, l1_ratio: float, ties: str, offset: str | None,
                      max_iter: int, tol: float, init: Sequence[float] | None) -> CoxModel:
    """Newton steps on standardised rows ``X`` (with a column ``off`` if there is an offset)."""
    feats, n, events, means, scales, max_d = rows.features, rows.n, rows.events, rows.means, rows.scales, rows.max_d
    p = len(feats)
    two_level = rows.n_times > SINGLE_WINDOW_MAX_ROWS
    bc = rows.n_times <= BROADCAST_TIMES
    tied = 2 * rows.n_times * _tied_width(p) <= TIED_CELLS
    lam_s = penalizer
    ll_null = None
    if init is not None:
        beta = np.asarray(init, float) * scales
    else:
        beta = np.zeros(p)
    ll, g, info = _step_stats(X, p, beta, ties, two_level, max_d, bc, bool(offset), tied)
    ll_null = ll if init is None else float("nan")
    pen, pg, ph = _penalty(beta, lam_s, l1_ratio, n) if penalizer else (0.0, 0.0, 0.0)
    obj = ll - pen
    it = 0
    for it in range(1, max_iter + 1):
        G = g - pg if penalizer else g
        H = info + ph if penalizer else info
        try:
            step = np.linalg.solve(H, G)
        except np.linalg.LinAlgError:
            step = np.linalg.pinv(H) @ G
        accepted = False
        shrink = 1.0
        for _ in range(20):
            nb = beta + shrink * step
            ll2, g2, info2 = _step_stats(X, p, nb, ties, two_level, max_d, bc, bool(offset), tied)
            pen2, pg2, ph2 = _penalty(nb, lam_s, l1_ratio, n) if penalizer else (0.0, 0.0, 0.0)
            if ll2 - pen2 >= obj - 1e-12 * abs(obj) or not np.isfinite(obj):
                accepted = True
                break
            shrink *= 0.5
        if not accepted:
            break
        improve = (ll2 - pen2) - obj
        beta, ll, g, info, pg, ph, obj = nb, ll2, g2, info2, pg2, ph2, ll2 - pen2
        if abs(improve) <= tol * max(1.0, abs(obj)) or float(np.max(np.abs(shrink * step))) < 1e-10:
            break
    H = info + ph if penalizer else info
    try:
        cov_s = np.linalg.inv(H)
    except np.linalg.LinAlgError:
        cov_s = np.linalg.pinv(H)
    coef = beta / scales
    cov = cov_s / np.outer(scales, scales)
    model = CoxModel(feats, coef, means, cov, float(ll), float(ll_null), n, events, it, ties, penalizer, l1_ratio,
                     offset=offset)
    model.baseline = _breslow_baseline(X, p, beta, two_level, bool(offset))
    return model


def _eta(p, beta, offset):
    eta = F.lit(0.0)
    for j in range(p):
        eta = eta + F.col(f"x{j}") * F.lit(float(beta[j]))
    if offset:
        eta = eta + F.col("off")
    return eta


def _breslow_baseline(X: DataFrame, p: int, beta: np.ndarray, two_level: bool, offset: bool) -> DataFrame:
    """Breslow cumulative baseline hazard at mean covariates: H0(t) = sum_{u<=t} d(u)/S0(u)."""
    w = F.exp(_eta(p, beta, offset))
    tt = X.groupBy(F.col("t").alias("time")).agg(F.sum(F.col("e").cast("double")).alias("d"),
                                                 F.sum(w).alias("S0p"))
    tt = cumulative(tt, "time", [], sums={"S0": "S0p"}, descending=True, force_two_level=two_level)
    tt = tt.withColumn("dh", F.col("d") / F.col("S0"))
    tt = cumulative(tt, "time", [], sums={"baseline_hazard": "dh"}, force_two_level=two_level)
    out = tt.select("time", "baseline_hazard", F.exp(-F.col("baseline_hazard")).alias("baseline_survival"))
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def cox_partial_loglik(df: DataFrame, time: str, event: str, features: Sequence[str],
                       beta: Sequence[float], ties: str = "efron") -> tuple[float, np.ndarray, np.ndarray]:
    """Log partial likelihood, gradient and information at a given beta (uncentred x)."""
    feats = list(features)
    p = len(feats)
    X = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                  *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(feats)])
    md = X.groupBy("t").agg(F.sum("e").alias("d")).agg(F.max("d")).first()[0] or 0
    return _step_stats(X, p, np.asarray(beta, float), ties, False, int(md), True, False)


def robust_variance(model: CoxModel, df: DataFrame, time: str, event: str,
                    cluster: str | None = None) -> np.ndarray:
    """M04 ``robust``: sandwich variance I^-1 (sum U U') I^-1 from score residuals, with the model's way of ties.

    At a time with d events the l-th (l = 0 .. d - 1) has f = l / d, z = S0 - f D0 and mean (S1 - f D1) / z, where D0
    and D1 sum over the events; Breslow has f = 0.  A row at risk contributes -w (x - mean) / z of each, a row with
    its event there only the share 1 - f, and x less the average mean.  So with running sums over time
        U_i = E_i (x_i - xbar) - w_i (x_i A(T_i) - B(T_i)) + E_i w_i (x_i c - b'),
    a = sum 1/z, b = sum mean/z, c = sum f/z, b' = sum f mean/z, and A, B the sums of a, b up to T_i.
    U is summed per cluster first when ``cluster`` is given.  One time table, one join, p x p products in NumPy batches.
    """
    feats = model.features
    p = len(feats)
    off = model.offset
    xs = [(F.col(f).cast("double") - float(model.means[j])).alias(f"x{j}") for j, f in enumerate(feats)]
    X = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("double").alias("e"),
                  *([F.col(cluster).alias("_cl")] if cluster else []), *([F.col(off).cast("double").alias("_off")] if off else []), *xs)
    eta = F.col("_off") if off else F.lit(0.0)
    for j in range(p):
        eta = eta + F.col(f"x{j}") * float(model.coef[j])
    X = X.withColumn("w", F.exp(eta))
    e, w = F.col("e"), F.col("w")
    tt = X.groupBy(F.col("t").alias("time")).agg(
        F.sum("e").alias("d"), F.sum("w").alias("S0p"), F.sum(e * w).alias("D0"),
        *[F.sum(w * F.col(f"x{j}")).alias(f"S1p{j}") for j in range(p)], *[F.sum(e * w * F.col(f"x{j}")).alias(f"D1{j}") for j in range(p)])
    tt = cumulative(tt, "time", [], sums={"S0": "S0p", **{f"S1{j}": f"S1p{j}" for j in range(p)}},
                    descending=True).persist(StorageLevel.MEMORY_AND_DISK)
    sums = tt
    n_times, most = tt.agg(F.count(F.lit(1)), F.max("d")).first()
    # times without an event add nothing to any sum
    zero = {c: F.when(F.col("d") > 0, F.col(c)).otherwise(0.0) for c in ("a", "c", "q0", "q1", "q2")}
    tt = _efron_terms(tt, p, model.ties, int(most or 0)).withColumns(zero)
    for j in range(p):
        s1, d1 = F.col(f"S1{j}"), F.col(f"D1{j}")
        tt = tt.withColumns({f"b{j}": s1 * F.col("q0") - d1 * F.col("q1"), f"bp{j}": s1 * F.col("q1") - d1 * F.col("q2"),
                             f"xb{j}": F.when(F.col("d") > 0, (s1 * F.col("a") - d1 * F.col("c")) / F.col("d")).otherwise(0.0)})
    tt = cumulative(tt, "time", [], sums={"A": "a", **{f"B{j}": f"b{j}" for j in range(p)}})
    tt = tt.select(F.col("time").alias("_t"), "A", "c", *[f"{n}{j}" for n in ("B", "bp", "xb") for j in range(p)])
    j_ = X.join(F.broadcast(tt) if n_times <= BROADCAST_TIMES else tt, X["t"] == tt["_t"])
    U = [(e * (F.col(f"x{j}") - F.col(f"xb{j}")) - w * (F.col(f"x{j}") * F.col("A") - F.col(f"B{j}"))
          + e * w * (F.col(f"x{j}") * F.col("c") - F.col(f"bp{j}"))).alias(f"u{j}") for j in range(p)]
    u = j_.select(*([F.col("_cl")] if cluster else []), *U)
    if cluster:
        u = u.groupBy("_cl").agg(*[F.sum(f"u{j}").alias(f"u{j}") for j in range(p)])
    us = [f"u{j}" for j in range(p)]

    def products(it):
        for pdf in it:
            if len(pdf):
                m = np.nan_to_num(pdf[us].to_numpy(float))
                yield pd.DataFrame({"v": [(m.T @ m).ravel()]})

    meat = _sum_rows(u.select(*us).mapInPandas(products, "v array<double>"), p * p, True).reshape(p, p)
    sums.unpersist()
    bread = model.variance
    return bread @ meat @ bread


def calibration_slope(model: CoxModel, df: DataFrame, time: str, event: str) -> float:
    """Cox coefficient of the model's linear predictor on (new) data; 1 = well calibrated."""
    lp = df.select(F.col(time).alias("_t"), F.col(event).alias("_e"), model.linear_predictor(df).alias("lp"))
    return float(cox_fit(lp, "_t", "_e", ["lp"], with_concordance=False).coef[0])
