"""Competing risks: cause-specific Cox, Fine-Gray subdistribution hazards and
cumulative incidence predictions (M14-M18).

Fine-Gray keeps subjects with a competing event at risk after their event
time with weight G(u-)/G(T_i-) (G = censoring KM).  The weighted risk set is
still a prefix sum:  sum over those rows = G(u-) * sum_{T_j < u} w_j/G(T_j-),
so a step is the same time table + running sums as the Cox fit, with one
extra forward running sum.  Breslow ties.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.stats import Z95, two_sided_p
from eventide.operators.additive import _time_buckets
from eventide.operators.cox import BROADCAST_TIMES, CoxModel, _many, _sum_rows
from eventide.operators.cox_grouped import cox_fit_grouped
from eventide.operators.logrank import group_values
from eventide.plans.scan import SINGLE_WINDOW_MAX_ROWS, cumulative, right_size
from eventide.session import cut_lineage


#: Baseline steps of one segment, distinct predictors of one piece, and numbers of one matrix in a task.
CIF_STEPS = 50_000
CIF_ROWS = 50_000
CIF_CELLS = 250_000


def cause_specific_fit(df: DataFrame, time: str, cause: str, features: Sequence[str],
                       causes: Sequence[int] | None = None, penalizer: float = 0.0,
                       ties: str = "efron") -> dict[int, CoxModel]:
    """One Cox per cause, other causes treated as censored (fitted together)."""
    ks = list(causes) if causes is not None else [c for c in group_values(df, cause) if c != 0]
    x = df.select(time, cause, *features,
                  F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("_cause_k"))
    x = x.withColumn("_ek", (F.col(cause) == F.col("_cause_k")).cast("int"))
    return cox_fit_grouped(x, "_cause_k", time, "_ek", features, penalizer=penalizer, ties=ties)


@dataclass
class FineGrayModel:
    cause: int
    features: list[str]
    coef: np.ndarray
    means: np.ndarray
    variance: np.ndarray
    loglik: float
    n: int
    events: float
    iterations: int
    baseline: DataFrame = field(repr=False, default=None)  # time, baseline_hazard (subdistribution)

    @property
    def se(self):
        return np.sqrt(np.maximum(np.diag(self.variance), 0.0))

    def coefficients(self, spark) -> DataFrame:
        rows = []
        for j, f in enumerate(self.features):
            b, s = float(self.coef[j]), float(self.se[j])
            z = b / s if s > 0 else float("nan")
            rows.append((int(self.cause), f, b, s, z, two_sided_p(z), math.exp(b),
                         b - Z95 * s, b + Z95 * s))
        return spark.createDataFrame(rows, "cause int, feature string, coef double, se double, z double, "
                                           "p_value double, hazard_ratio double, ci_lower double, ci_upper double")

    def linear_predictor(self):
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + (F.col(f).cast("double") - float(self.means[j])) * float(self.coef[j])
        return lp

    def predict_cif(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """CIF_k(t|x) = 1 - exp(-H_k(t) exp(lp)) at the requested times."""
        aggs = [F.max(F.when(F.col("time") <= float(t), F.col("baseline_hazard"))).alias(f"h{i}")
                for i, t in enumerate(times)]
        row = self.baseline.agg(*aggs).first()
        hs = [float(row[f"h{i}"] or 0.0) for i in range(len(times))]
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(h).alias("h"))
                                   for t, h in zip(times, hs)])).alias("g")
        x = df.select(*keep, F.exp(self.linear_predictor()).alias("_r"), grid)
        return x.select(*keep, F.col("g.time").alias("time"),
                        (1.0 - F.exp(-F.col("g.h") * F.col("_r"))).alias("cif"))


def _censoring_left(df: DataFrame, time: str, cause: str) -> DataFrame:
    """time, Gm = G(time-) for the censoring distribution (cause == 0 is censoring)."""
    c = (F.col(cause) == 0).cast("long")
    tt = df.groupBy(F.col(time).cast("double").alias("time")).agg(
        F.sum(c).alias("c"), F.sum(1 - c).alias("d"), F.count(F.lit(1)).alias("m"))
    tt = cumulative(tt, "time", [], sums={"n": "m"}, descending=True)
    f = F.coalesce(1.0 - F.try_divide(F.col("c").cast("double"), (F.col("n") - F.col("d")).cast("double")),
                   F.lit(1.0))
    return cumulative(tt.withColumn("_f", f), "time", [], products={"Gm": "_f"}, exclusive=True) \
        .select("time", "Gm")


def _fg_stats(X: DataFrame, Gt: DataFrame, p: int, beta: np.ndarray, two_level: bool, broadcast_times: bool):
    """Log likelihood, gradient and information at ``beta``; sums over rows and p x p products are made
    in NumPy batches and added up by Spark, as in the Cox steps."""
    xs, beta = [f"x{j}" for j in range(p)], np.asarray(beta, float)
    cols = ["t", "e", "comp", "gm", *xs]
    names = ["d", "S0p", "C0p"] + [f"S1p{j}" for j in range(p)] + [f"C1p{j}" for j in range(p)]

    def parts(pdf):
        x = pdf[xs].to_numpy(float).reshape(len(pdf), p)
        eta, gm = x @ beta, pdf["gm"].to_numpy(float)
        late = (pdf["comp"].to_numpy() == 1) & (gm > 0)  # competing events stay at risk with weight G / gm
        inv = np.divide(1.0, gm, out=np.zeros(len(pdf)), where=late)
        return x, eta, np.exp(eta), inv, pdf["e"].to_numpy(float)

    def by_time(it):
        for pdf in it:
            if not len(pdf):
                continue
            x, _, w, inv, e = parts(pdf)
            cw = w * inv
            sums = np.column_stack([e, w, cw, w[:, None] * x, cw[:, None] * x])
            t = pdf["t"].to_numpy(float)
            order = np.argsort(t, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
            yield pd.DataFrame(np.add.reduceat(sums[order], at, axis=0), columns=names).assign(time=t[order][at])

    tt = X.select(*cols).mapInPandas(by_time, ", ".join(f"{n} double" for n in [*names, "time"]))
    tt = tt.groupBy("time").agg(*[F.sum(n).alias(n) for n in names]).join(Gt, "time", "inner")
    tt = cumulative(tt, "time", [], sums={"S0r": "S0p", **{f"S1r{j}": f"S1p{j}" for j in range(p)}},
                    descending=True, force_two_level=two_level)
    tt = cumulative(tt, "time", [], sums={"C0c": "C0p", **{f"C1c{j}": f"C1p{j}" for j in range(p)}},
                    exclusive=True, force_two_level=two_level)
    tt = tt.withColumn("S0", F.col("S0r") + F.col("Gm") * F.col("C0c"))
    tt = tt.withColumns({f"S1{j}": F.col(f"S1r{j}") + F.col("Gm") * F.col(f"C1c{j}") for j in range(p)})
    d = F.col("d")
    tt = (tt.withColumn("a", F.when(d > 0, d / F.col("S0")).otherwise(0.0))
          .withColumn("q0", F.when(d > 0, d / (F.col("S0") * F.col("S0"))).otherwise(0.0))
          .withColumn("L", F.when(d > 0, d * F.log("S0")).otherwise(0.0))
          .withColumn("aG", F.col("a") * F.col("Gm")))
    tt = tt.persist(StorageLevel.MEMORY_AND_DISK)

    def over_times(it):
        for pdf in it:
            if len(pdf):
                S1 = pdf[[f"S1{j}" for j in range(p)]].to_numpy(float).reshape(len(pdf), p)
                M = (S1 * pdf["q0"].to_numpy(float)[:, None]).T @ S1
                yield pd.DataFrame({"v": [np.concatenate([[pdf["L"].sum()], M.ravel()])]})

    times = _sum_rows(tt.select("L", "q0", *[f"S1{j}" for j in range(p)]).mapInPandas(over_times, "v array<double>"), 1 + p * p, _many(X))
    ab = cumulative(tt.select("time", "a", "aG"), "time", [], sums={"A": "a"}, force_two_level=two_level)
    ab = cumulative(ab, "time", [], sums={"B": "aG"}, descending=True, exclusive=True, force_two_level=two_level)
    ab = ab.select(F.col("time").alias("_t"), "A", "B")
    ab = F.broadcast(ab) if broadcast_times else ab

    def over_rows(it):
        for pdf in it:
            if len(pdf):
                x, eta, w, inv, e = parts(pdf)
                s = w * (pdf["A"].to_numpy(float) + pdf["B"].to_numpy(float) * inv)
                yield pd.DataFrame({"v": [np.concatenate([[(e * eta).sum()], x.T @ (e - s), ((x * s[:, None]).T @ x).ravel()])]})

    j = X.join(ab, X["t"] == ab["_t"], "inner").select(*cols, "A", "B")
    rows = _sum_rows(j.mapInPandas(over_rows, "v array<double>"), 1 + p + p * p, _many(X))
    tt.unpersist()
    info = rows[1 + p:].reshape(p, p) - times[1:].reshape(p, p)
    return rows[0] - times[0], rows[1:1 + p], (info + info.T) / 2


def fine_gray_fit(df: DataFrame, time: str, cause: str, features: Sequence[str], cause_of_interest: int = 1,
                  max_iter: int = 25, tol: float = 1e-9) -> FineGrayModel:
    """Fine & Gray (1999) proportional subdistribution hazards for one cause."""
    feats = list(features)
    p = len(feats)
    st = df.agg(F.count(F.lit(1)).alias("n"),
                F.sum((F.col(cause) == cause_of_interest).cast("double")).alias("ev"),
                *[F.avg(F.col(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{j}") for j, f in enumerate(feats)]).first()
    means = np.array([st[f"m{j}"] or 0.0 for j in range(p)])
    scales = np.array([st[f"s{j}"] or 0.0 for j in range(p)])
    scales = np.where(scales > 0, scales, 1.0)
    Gt = _censoring_left(df, time, cause).persist(StorageLevel.MEMORY_AND_DISK)
    base = df.select(F.col(time).cast("double").alias("t"),
                     (F.col(cause) == cause_of_interest).cast("int").alias("e"),
                     ((F.col(cause) != 0) & (F.col(cause) != cause_of_interest)).cast("int").alias("comp"),
                     *[((F.col(f).cast("double") - float(means[j])) / float(scales[j])).alias(f"x{j}")
                       for j, f in enumerate(feats)])
    n_times = Gt.count()  # decides once how times are scanned and joined
    two_level, bc = n_times > SINGLE_WINDOW_MAX_ROWS, n_times <= BROADCAST_TIMES
    gm = Gt.select(F.col("time").alias("t"), F.col("Gm").alias("gm"))
    X = base.join(F.broadcast(gm) if bc else gm, "t", "inner")
    X = right_size(X, int(st["n"])).persist(StorageLevel.MEMORY_AND_DISK)
    beta = np.zeros(p)
    ll, g, info = _fg_stats(X, Gt, p, beta, two_level, bc)
    it = 0
    for it in range(1, max_iter + 1):
        step = np.linalg.solve(info, g)
        shrink = 1.0
        ok = False
        for _ in range(20):
            nb = beta + shrink * step
            ll2, g2, info2 = _fg_stats(X, Gt, p, nb, two_level, bc)
            if ll2 >= ll - 1e-12 * abs(ll):
                ok = True
                break
            shrink *= 0.5
        if not ok:
            break
        imp = ll2 - ll
        beta, ll, g, info = nb, ll2, g2, info2
        if abs(imp) <= tol * max(1.0, abs(ll)):
            break
    cov = np.linalg.inv(info) / np.outer(scales, scales)
    m = FineGrayModel(int(cause_of_interest), feats, beta / scales, means, cov, ll, int(st["n"]),
                      float(st["ev"] or 0.0), it)
    # Breslow subdistribution baseline at the fitted beta
    xs = [F.col(f"x{j}") for j in range(p)]
    eta = F.lit(0.0)
    for j in range(p):
        eta = eta + xs[j] * float(beta[j])
    X1 = X.withColumn("w", F.exp(eta))
    cw = F.when((F.col("comp") == 1) & (F.col("gm") > 0), F.col("w") / F.col("gm")).otherwise(0.0)
    tt = X1.groupBy(F.col("t").alias("time")).agg(F.sum(F.col("e").cast("double")).alias("d"),
                                                  F.sum("w").alias("S0p"), F.sum(cw).alias("C0p")).join(Gt, "time")
    tt = cumulative(tt, "time", [], sums={"S0r": "S0p"}, descending=True, force_two_level=two_level)
    tt = cumulative(tt, "time", [], sums={"C0c": "C0p"}, exclusive=True, force_two_level=two_level)
    tt = tt.withColumn("dh", F.col("d") / (F.col("S0r") + F.col("Gm") * F.col("C0c")))
    tt = cumulative(tt, "time", [], sums={"baseline_hazard": "dh"}, force_two_level=two_level)
    m.baseline = tt.select("time", "baseline_hazard").persist(StorageLevel.MEMORY_AND_DISK)
    X.unpersist()
    return m


def _segments(models: dict, last: float | None, steps_each: int) -> tuple[DataFrame, list]:
    """(table, ends): every cause's baseline by time (null where a cause has no step) with its segment ``_bucket``;
    and one row a segment, in order: its first time and each cause's highest hazard in it (null: no step)."""
    base = None
    for k in sorted(models):
        b = models[k].baseline.select(F.col("time").cast("double").alias("time"), F.col("baseline_hazard").alias(f"H{k}"))
        base = b if base is None else base.join(b, "time", "full_outer")
    table, _ = _time_buckets(base if last is None else base.where(F.col("time") <= last), steps_each)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    ends = table.groupBy("_bucket").agg(F.min("time").alias("first"), *[F.max(f"H{k}").alias(f"H{k}") for k in sorted(models)])
    return table, ends.orderBy("_bucket").collect()


def _segment_steps(causes: list, ends: list):
    """A function of one segment's rows of the table: its times and, for each cause, the hazard increments."""
    before, reached = {}, [0.0] * len(causes)
    for r in ends:
        before[r["_bucket"]] = list(reached)
        reached = [max(h, r[f"H{k}"] or 0.0) for h, k in zip(reached, causes)]

    def steps(pdf):
        pdf = pdf.sort_values("time")
        start = np.array(before[int(pdf["_bucket"].iloc[0])])[:, None]
        H = np.nan_to_num(np.stack([pdf[f"H{k}"].to_numpy(float) for k in causes]), nan=0.0)
        H = np.maximum.accumulate(np.concatenate([start, H], axis=1), axis=1)  # a hazard never falls
        return pdf["time"].to_numpy(float), np.diff(H, axis=1)
    return steps


def _predictors(models: dict, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame, list]:
    """Rows with their linear predictors (null: NaN), the distinct predictors dealt into pieces, and their names."""
    lps = [f"lp{k}" for k in sorted(models)]
    x = df.select(F.col(key), *[F.coalesce(models[k].linear_predictor(df), F.lit(float("nan"))).alias(f"lp{k}") for k in sorted(models)])
    distinct = cut_lineage(x.select(*lps).distinct())
    pieces = max(1, -(-distinct.count() // CIF_ROWS))
    return x, distinct.withColumn("_piece", F.pmod(F.xxhash64(*lps), F.lit(pieces)).cast("int")), lps


def _on_segments(dealt: DataFrame, table: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(predictors, steps)`` for each piece of ``dealt`` (..., _piece, _bucket) and the segment that it names."""
    pieces = (dealt.agg(F.max("_piece")).first()[0] or 0) + 1
    copies = table.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    got = dealt.groupBy("_bucket", "_piece").cogroup(copies.groupBy("_bucket", "_piece")).applyInPandas(fn, schema)
    return got.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in dealt.columns if c.startswith("lp")})  # pandas made NaN null


def _inside(causes: list, pdf: pd.DataFrame, dH: np.ndarray):
    """Chunks (rows, hazard ratios, survival from the segment's start after 0, 1, ... steps) of bounded size."""
    each = max(1, CIF_CELLS // (dH.shape[1] + 1))
    for a in range(0, len(pdf), each):
        part = pdf.iloc[a:a + each]
        r = np.exp(np.stack([part[f"lp{k}"].to_numpy(float) for k in causes], axis=1))
        # product-limit all-cause survival, so S + sum_k CIF_k = 1 exactly
        S = np.ones((len(part), dH.shape[1] + 1))
        np.maximum(1.0 - r @ dH, 0.0, out=S[:, 1:])
        yield part, r, np.multiply.accumulate(S, axis=1, out=S)


def cause_specific_cif(models: dict, df: DataFrame, times: Sequence[float], key: str, steps_each: int | None = None) -> DataFrame:
    """M16/M17 for cause-specific models: per row and requested time, CIF of every
    cause and the all-cause survival.

    CIF_k(t|x) = sum_{u<=t} S(u-|x) dH_k(u|x) with S(u|x) = prod_{v<=u} (1 - sum_k dH_k(v|x))
    needs every baseline step up to t, so time is cut into segments of about ``steps_each`` steps.  A
    (segment, piece of the distinct linear predictors) is one group of a cogroup: it gives the segment's
    survival factor and its integrals, whole and up to each requested time in it.  What the segments
    before have left (a running product and running sums per predictor) is joined on afterwards, and
    the answers go back to the rows by their predictors.  The baseline stays a table at every size.
    Rows with a null covariate have survival and CIFs null or NaN; before the first step they are 1 and 0.
    """
    x, dealt, lps = _predictors(models, df, key)
    return _incidence(models, x, dealt, lps, times, [key], steps_each)


def _incidence(models: dict, x: DataFrame, dealt: DataFrame, lps: list, times: Sequence[float], keep: list,
               steps_each: int | None) -> DataFrame:
    """``cause_specific_cif`` of rows ``x`` (keep..., predictors) whose distinct predictors are ``dealt``."""
    causes, times = sorted(models), [float(t) for t in times]
    table, ends = _segments(models, max(times), steps_each or CIF_STEPS)
    answer = [*keep, "time", "survival", *[f"cif_{k}" for k in causes]]
    if not ends:  # no step up to the last requested time
        at = F.explode(F.array(*[F.lit(t) for t in times])).alias("time")
        return x.select(*keep, at, F.lit(1.0).alias("survival"), *[F.lit(0.0).alias(f"cif_{k}") for k in causes])
    steps = _segment_steps(causes, ends)
    firsts = [r["first"] for r in ends]
    asked = {r["_bucket"]: [] for r in ends}
    for t in times:  # each time is answered by the last segment that starts before it
        asked[ends[max(0, int(np.searchsorted(firsts, t, side="right")) - 1)]["_bucket"]].append(t)

    def segment(left, right):
        if left.empty:
            return pd.DataFrame({c: [] for c in [*lps, "_bucket", "p", *cs, "at"]})
        at, dH = steps(right)
        bucket = int(right["_bucket"].iloc[0])
        ts = np.array(asked[bucket])
        pos = np.searchsorted(at, ts, side="right")
        cuts = np.unique(np.concatenate([[0, len(at)], pos]).astype(int))  # integrals are needed at these steps only
        where = np.searchsorted(cuts, pos)
        out = []
        for part, r, S in _inside(causes, left, dH):
            got = part[lps].assign(_bucket=bucket, p=S[:, -1])
            cif = np.zeros((len(cuts), len(part), len(causes)))
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                cif[i + 1] = cif[i] + r * (S[:, a:b] @ dH[:, a:b].T)
            for i, k in enumerate(causes):
                got[f"c{k}"] = cif[-1, :, i]
            # survival, then each cause's integral, at the segment's times
            got["at"] = list(np.concatenate([S[:, pos], *[cif[where, :, i].T for i in range(len(causes))]], axis=1))
            out.append(got)
        return pd.concat(out)

    cs = [f"c{k}" for k in causes]
    schema = ", ".join([*[f"{c} double" for c in [*lps, "p", *cs]], "at array<double>", "_bucket int"])
    where = F.explode(F.array(*[F.lit(int(r["_bucket"])) for r in ends])) if len(ends) > 1 else F.lit(int(ends[0]["_bucket"]))
    got = _on_segments(dealt.withColumn("_bucket", where), table, segment, schema)
    if len(ends) > 1:
        earlier = Window.partitionBy(*lps).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        got = got.withColumn("s0", F.coalesce(F.product("p").over(earlier), F.lit(1.0)))
        got = got.withColumns({f"c0_{k}": F.coalesce(F.sum(F.col("s0") * F.col(f"c{k}")).over(earlier), F.lit(0.0)) for k in causes})
    else:
        got = got.withColumns({"s0": F.lit(1.0), **{f"c0_{k}": F.lit(0.0) for k in causes}})
    times_of = F.create_map(*[c for k, ts in asked.items() for c in (F.lit(int(k)), F.array(*[F.lit(t) for t in ts]).cast("array<double>"))])
    got = got.withColumn("_ts", F.element_at(times_of, F.col("_bucket"))).where(F.size("_ts") > 0)
    got = got.select(*lps, "s0", *[f"c0_{k}" for k in causes], "at", "_ts")
    long = x.join(got, lps).select(*keep, "s0", *[f"c0_{k}" for k in causes], "at", F.size("_ts").alias("_m"), F.posexplode("_ts").alias("_i", "time"))
    return long.select(*keep, "time", (F.col("s0") * F.get("at", F.col("_i"))).alias("survival"), *[
        (F.col(f"c0_{k}") + F.col("s0") * F.get("at", F.col("_i") + F.lit(i) * F.col("_m"))).alias(f"cif_{k}")
        for i, k in enumerate(causes, 1)]).select(*answer)


def cause_specific_median(models: dict, df: DataFrame, key: str, steps_each: int | None = None) -> DataFrame:
    """(key, median_time): the first step of any cause with all-cause S <= 0.5, +inf if none, null if a predictor is
    null.  The segments' factors say in which segment S crosses; only that one is looked through step by step."""
    x, dealt, lps = _predictors(models, df, key)
    return _with_crossings(x, _crossings(models, dealt, lps, steps_each), lps, ["median_time"]).select(key, "median_time")


def _with_crossings(x: DataFrame, found: DataFrame | None, lps: list, names: list) -> DataFrame:
    """``x`` with the times of ``_crossings``: +inf if there is none, null if a predictor is null."""
    if found is None:
        return x.withColumns({c: F.lit(math.inf) for c in names})
    unknown = F.isnan(sum((F.col(c) for c in lps), F.lit(0.0)))
    return x.join(found, lps, "left").withColumns({c: F.when(~unknown, F.coalesce(c, F.lit(math.inf))) for c in names})


def _crossings(models: dict, dealt: DataFrame, lps: list, steps_each: int | None, each_cause: bool = False) -> DataFrame | None:
    """(predictors, median_time): the first step with all-cause S <= 0.5; with ``each_cause`` also median_k, the first
    step with CIF_k >= 0.5 (null: none).  Predictors that cross nowhere can be missing; None: there is no step."""
    causes = sorted(models)
    wanted = causes if each_cause else []
    table, ends = _segments(models, None, steps_each or CIF_STEPS)
    if not ends:
        return None
    steps = _segment_steps(causes, ends)
    sums, names = [f"c{k}" for k in wanted], ["median_time", *[f"median_{k}" for k in wanted]]

    def whole(r, S, dH):
        """Each wanted cause's integral over the segment, from its start."""
        before = S[:, :-1]
        return {k: r[:, causes.index(k)] * np.einsum("ij,j->i", before, dH[causes.index(k)]) for k in wanted}

    def factor(left, right):
        if left.empty:
            return pd.DataFrame({c: [] for c in [*lps, "_piece", "_bucket", "p", *sums]})
        _, dH = steps(right)
        return pd.concat([part[[*lps, "_piece", "_bucket"]].assign(p=S[:, -1], **{f"c{k}": v for k, v in whole(r, S, dH).items()})
                          for part, r, S in _inside(causes, left, dH)])

    def crossing(left, right):
        if left.empty:
            return pd.DataFrame({c: [] for c in [*lps, *names]})
        at, dH = steps(right)
        out = []
        for part, r, S in _inside(causes, left, dH):
            s0 = part["s0"].to_numpy(float)
            low = s0[:, None] * S[:, 1:] <= 0.5
            got = part[lps].assign(median_time=np.where((s0 > 0.5) & low[:, -1], at[low.argmax(axis=1)], np.nan))
            for k, v in whole(r, S, dH).items():
                c0 = part[f"c0_{k}"].to_numpy(float)
                rows = np.flatnonzero((c0 < 0.5) & (c0 + s0 * v >= 0.5))  # at most about one cause a row
                cif = np.cumsum(S[rows, :-1] * dH[causes.index(k)], axis=1)
                cif = c0[rows, None] + s0[rows, None] * (r[rows, causes.index(k)][:, None] * cif) >= 0.5
                cif[:, -1] = True
                when = np.full(len(part), np.nan)
                when[rows] = at[cif.argmax(axis=1)]
                got[f"median_{k}"] = when
            out.append(got)
        return pd.concat(out)

    predictors = ", ".join(f"{c} double" for c in lps)
    if len(ends) > 1:
        where = F.explode(F.array(*[F.lit(int(r["_bucket"])) for r in ends]))
        got = _on_segments(dealt.withColumn("_bucket", where), table, factor,
                           ", ".join([predictors, "_piece int, _bucket int, p double", *[f"{c} double" for c in sums]]))
        earlier = Window.partitionBy(*lps).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        got = got.withColumn("s0", F.coalesce(F.product("p").over(earlier), F.lit(1.0)))
        got = got.withColumns({f"c0_{k}": F.coalesce(F.sum(F.col("s0") * F.col(f"c{k}")).over(earlier), F.lit(0.0)) for k in wanted})
        some = (F.col("s0") > 0.5) & (F.col("s0") * F.col("p") <= 0.5)
        for k in wanted:
            some = some | (F.col(f"c0_{k}") < 0.5) & (F.col(f"c0_{k}") + F.col("s0") * F.col(f"c{k}") >= 0.5)
        got = cut_lineage(got.where(some))
    else:
        got = dealt.withColumns({"_bucket": F.lit(int(ends[0]["_bucket"])), "s0": F.lit(1.0), **{f"c0_{k}": F.lit(0.0) for k in wanted}})
    found = _on_segments(got, table, crossing, ", ".join([predictors, *[f"{c} double" for c in names]]))
    return found.groupBy(*lps).agg(*[F.min(c).alias(c) for c in names]) if each_cause else found.where("median_time IS NOT NULL")


def competing_predict(models: dict, df: DataFrame, times: Sequence[float], key: str, steps_each: int | None = None) -> DataFrame:
    """A row per row of ``df`` and requested time.

    * survival, cif_k: all-cause S and each cause's CIF, as ``cause_specific_cif`` (S + sum_k CIF_k = 1);
    * survival_k, all_cause_survival: S_k = exp(-H_k(t) exp(lp_k)) and their product over the causes, the steps of all
      causes up to t;
    * risk, risk_k: the sum of the causes' partial hazards, and each one;
    * median_time, median_k: the first step of any cause with S <= 0.5, and with CIF_k >= 0.5; +inf if never.

    A null covariate leaves risks and medians null.
    """
    causes, times = sorted(models), [float(t) for t in times]
    x, dealt, lps = _predictors(models, df, key)
    medians = ["median_time", *[f"median_{k}" for k in causes]]
    x = _with_crossings(x, _crossings(models, dealt, lps, steps_each, each_cause=True), lps, medians)
    risks = {f"risk_{k}": F.exp(F.when(~F.isnan(f"lp{k}"), F.col(f"lp{k}"))) for k in causes}
    x = x.withColumns(risks).withColumn("risk", sum((F.col(c) for c in risks), F.lit(0.0)))
    out = _incidence(models, x, dealt, lps, times, [key, "risk", *risks, *medians], steps_each)
    for k in causes:
        reached = dict(zip(times, models[k].baseline_at(times), strict=True))
        h = F.element_at(F.create_map(*[F.lit(v) for pair in reached.items() for v in pair]), F.col("time"))
        out = out.withColumn(f"survival_{k}", F.exp(-h * F.col(f"risk_{k}")))
    product = F.lit(1.0)
    for k in causes:
        product = product * F.col(f"survival_{k}")
    return out.select(key, "time", "survival", *[f"cif_{k}" for k in causes], *[f"survival_{k}" for k in causes],
                      product.alias("all_cause_survival"), "risk", *risks, *medians)


def competing_importance(models: dict, spark) -> DataFrame:
    """Per-cause coefficient table plus the mean over causes (cause = NULL)."""
    parts = []
    for k, m in sorted(models.items()):
        parts.append(m.coefficients(spark).withColumn("cause", F.lit(int(k))))
    allc = parts[0]
    for p in parts[1:]:
        allc = allc.unionByName(p)
    mean = allc.groupBy("feature").agg(F.avg("coef").alias("coef"), F.avg("p_value").alias("p_value"),
                                       F.avg("hazard_ratio").alias("hazard_ratio"))
    return allc.select("cause", "feature", "coef", "p_value", "hazard_ratio").unionByName(
        mean.select(F.lit(None).cast("int").alias("cause"), "feature", "coef", "p_value", "hazard_ratio"))


def competing_summary(cif: DataFrame, key: str, cause: int | None = None) -> DataFrame:
    """Per row risk = sum of CIFs (or one cause's CIF) at the last requested time; median =
    first requested time with all-cause S <= 0.5 (or the cause's CIF >= 0.5), +inf if never."""
    cif_cols = [c for c in cif.columns if c.startswith("cif_")]
    tot = sum((F.col(c) for c in cif_cols), F.lit(0.0)) if cause is None else F.col(f"cif_{cause}")
    reach = (F.col("survival") <= 0.5) if cause is None else (F.col(f"cif_{cause}") >= 0.5)
    return cif.groupBy(key).agg(F.max_by(tot, F.col("time")).alias("risk"),
                                F.coalesce(F.min(F.when(reach, F.col("time"))), F.lit(float("inf")))
                                .alias("median_time"))
