"""Many independent Cox models fitted together, one per group.

Cause-specific hazards (one model per cause) and multi-state models (one per
transition) are sets of Cox models on different row sets.  Instead of a
Newton loop per model, every step evaluates all groups in the same jobs: the
time table is grouped by (group, time), running sums are partitioned by
group, coefficients are looked up per row from a small map literal, and the
gradients / information matrices are aggregated per group.  Each group keeps
its own step size and stops on its own.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.cox import BROADCAST_TIMES, CoxModel, _efron_terms
from eventide.plans.scan import ROWS_PER_BUCKET, SINGLE_WINDOW_MAX_ROWS, cumulative, right_size

MAX_GROUPS = 1000


def _beta_map(betas: dict, p: int):
    kv = []
    for k, b in betas.items():
        kv += [F.lit(k), F.array(*[F.lit(float(v)) for v in b])]
    return F.create_map(*kv)


def _grouped_stats(X: DataFrame, p: int, betas: dict, ties: str, two_level: bool, max_d: int, bc: bool,
                   n_buckets: int | None = None):
    bm = _beta_map(betas, p)
    X1 = X.withColumn("_b", F.element_at(bm, F.col("g")))
    eta = " + ".join([f"x{j} * _b[{j}]" for j in range(p)] or ["0.0"])
    X1 = X1.withColumn("eta", F.expr(eta)).withColumn("w", F.exp("eta")).drop("_b")
    aggs = ["sum(e) AS d", "sum(w) AS S0p", "sum(e * w) AS D0"]
    aggs += [f"sum(w * x{j}) AS S1p{j}" for j in range(p)] + [f"sum(e * w * x{j}) AS D1{j}" for j in range(p)]
    kept = []  # a two-level scan reads its table several times (bounds, totals, rows): computed once each

    def once(table):
        if two_level:
            kept.append(table.persist(StorageLevel.MEMORY_AND_DISK))
        return table

    tt = once(X1.groupBy("g", F.col("t").alias("time")).agg(*[F.expr(a) for a in aggs]))
    tt = cumulative(tt, "time", ["g"], sums={"S0": "S0p", **{f"S1{j}": f"S1p{j}" for j in range(p)}},
                    descending=True, force_two_level=two_level, n_buckets=n_buckets)
    ev = once(_efron_terms(tt, p, ties, max_d))
    ev = cumulative(ev, "time", ["g"], sums={"A": "a"}, force_two_level=two_level, n_buckets=n_buckets)
    ev = ev.persist(StorageLevel.MEMORY_AND_DISK)
    taggs = ["sum(L) AS L"] + [
        f"sum(S1{a} * S1{b} * q0 - (S1{a} * D1{b} + D1{a} * S1{b}) * q1 + D1{a} * D1{b} * q2) AS M{a}_{b}"
        for a in range(p) for b in range(a, p)]
    trows = {r["g"]: r.asDict() for r in ev.groupBy("g").agg(*[F.expr(x) for x in taggs]).collect()}
    at = ev.select(F.col("g").alias("_g"), F.col("time").alias("_t"), "A", "c")
    at = F.broadcast(at) if bc else at
    j = X1.join(at, (X1["g"] == at["_g"]) & (X1["t"] == at["_t"]), "inner").withColumn(
        "s", F.expr("w * (A - e * c)"))
    raggs = ["sum(e * eta) AS ll1", "count(1) AS n", "sum(e) AS ev"]
    raggs += [f"sum(x{a} * (e - s)) AS g{a}" for a in range(p)]
    raggs += [f"sum(s * x{a} * x{b}) AS I{a}_{b}" for a in range(p) for b in range(a, p)]
    rrows = {r["g"]: r.asDict() for r in j.groupBy("g").agg(*[F.expr(x) for x in raggs]).collect()}
    for table in [ev, *kept]:
        table.unpersist()
    out = {}
    for k, rr in rrows.items():
        tr = trows.get(k, {})
        ll = (rr["ll1"] or 0.0) - (tr.get("L") or 0.0)
        g = np.array([rr[f"g{a}"] or 0.0 for a in range(p)])
        info = np.zeros((p, p))
        for a in range(p):
            for b in range(a, p):
                info[a, b] = info[b, a] = (rr[f"I{a}_{b}"] or 0.0) - (tr.get(f"M{a}_{b}") or 0.0)
        out[k] = (ll, g, info, int(rr["n"]), float(rr["ev"] or 0.0))
    return out


def cox_fit_grouped(df: DataFrame, group: str, time: str, event: str, features, penalizer: float = 0.0,
                    ties: str = "efron", max_iter: int = 25, tol: float = 1e-9,
                    min_events: int = 1) -> dict:
    """One Cox model per value of ``group``; groups with fewer than ``min_events``
    events or a singular fit are skipped (reported as missing)."""
    feats = list(features)
    p = len(feats)
    st = df.groupBy(group).agg(F.sum(F.col(event).cast("double")).alias("ev")).limit(MAX_GROUPS + 1).collect()
    if len(st) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    groups = [r[group] for r in st if (r["ev"] or 0) >= min_events]
    stats = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                   *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{j}") for j, f in enumerate(feats)]).first()
    means = np.array([stats[f"m{j}"] or 0.0 for j in range(p)])
    scales = np.array([stats[f"s{j}"] or 0.0 for j in range(p)])
    scales = np.where(scales > 0, scales, 1.0)
    X = df.where(F.col(group).isin(groups)).select(
        F.col(group).alias("g"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
        *[((F.col(f).cast("double") - float(means[j])) / float(scales[j])).alias(f"x{j}")
          for j, f in enumerate(feats)])
    X = right_size(X).persist(StorageLevel.MEMORY_AND_DISK)
    ti = X.groupBy("g", "t").agg(F.sum("e").alias("d")).agg(F.count(F.lit(1)).alias("nt"),
                                                            F.max("d").alias("md")).first()
    two_level = int(ti["nt"]) > SINGLE_WINDOW_MAX_ROWS
    bc = int(ti["nt"]) <= BROADCAST_TIMES
    n_buckets = max(8, -(-int(ti["nt"]) // ROWS_PER_BUCKET))
    max_d = int(ti["md"] or 0)
    betas = {k: np.zeros(p) for k in groups}
    cur = _grouped_stats(X, p, betas, ties, two_level, max_d, bc, n_buckets)
    n_of = {k: (v[3], v[4]) for k, v in cur.items()}

    def pen(b, n):
        return (0.5 * n * penalizer * float(b @ b), n * penalizer * b, n * penalizer * np.eye(p))

    ll0 = {k: v[0] for k, v in cur.items()}
    obj = {k: cur[k][0] - pen(betas[k], n_of[k][0])[0] for k in cur}
    active = set(cur)
    steps = {}
    shrink = {k: 1.0 for k in cur}
    iters = {k: 0 for k in cur}
    failed = set()
    for _ in range(max_iter * 4):
        if not active:
            break
        cand = dict(betas)
        for k in active:
            ll, g, info, n, _e = cur[k]
            _, pg, ph = pen(betas[k], n)
            if k not in steps:
                try:
                    steps[k] = np.linalg.solve(info + ph, g - pg)
                except np.linalg.LinAlgError:
                    failed.add(k)
                    continue
            cand[k] = betas[k] + shrink[k] * steps[k]
        active -= failed
        if not active:
            break
        rows = X if len(active) == len(cur) else X.where(F.col("g").isin(sorted(active)))  # finished groups rest
        new = _grouped_stats(rows, p, {k: cand[k] for k in active}, ties, two_level, max_d, bc, n_buckets)
        for k in list(active):
            ll2, g2, info2, n, _e = new[k]
            o2 = ll2 - pen(cand[k], n)[0]
            if np.isfinite(o2) and o2 >= obj[k] - 1e-12 * abs(obj[k]):
                improve = o2 - obj[k]
                move = float(np.max(np.abs(shrink[k] * steps[k])))
                betas[k], cur[k], obj[k] = cand[k], new[k], o2
                iters[k] += 1
                steps.pop(k)
                shrink[k] = 1.0
                if abs(improve) <= tol * max(1.0, abs(o2)) or move < 1e-10 or iters[k] >= max_iter:
                    active.discard(k)
            else:
                shrink[k] *= 0.5
                if shrink[k] < 1e-6:
                    active.discard(k)
    models = {}
    for k in cur:
        if k in failed:
            continue
        ll, g, info, n, ev = cur[k]
        _, _, ph = pen(betas[k], n)
        try:
            cov_s = np.linalg.inv(info + ph)
        except np.linalg.LinAlgError:
            continue
        m = CoxModel(feats, betas[k] / scales, means, cov_s / np.outer(scales, scales), float(ll), float(ll0[k]), n, ev,
                     iters[k], ties, penalizer, 0.0)
        models[k] = m
    _attach_baselines(X, p, {k: betas[k] for k in models}, models, two_level, n_buckets)
    X.unpersist()
    return models


def _attach_baselines(X, p, betas, models, two_level, n_buckets=None):
    """Breslow baselines of all groups in one job; each model gets its slice."""
    if not betas:
        return
    bm = _beta_map(betas, p)
    bvec = F.element_at(bm, F.col("g"))
    eta = F.lit(0.0)
    for j in range(p):
        eta = eta + F.col(f"x{j}") * bvec[j]
    tt = X.where(F.col("g").isin(list(betas))).groupBy("g", F.col("t").alias("time")).agg(
        F.sum(F.col("e").cast("double")).alias("d"), F.sum(F.exp(eta)).alias("S0p"))
    if two_level:
        tt = tt.persist(StorageLevel.MEMORY_AND_DISK)
    at_risk = cumulative(tt, "time", ["g"], sums={"S0": "S0p"}, descending=True, force_two_level=two_level,
                         n_buckets=n_buckets).withColumn("dh", F.col("d") / F.col("S0"))
    if two_level:
        at_risk = at_risk.persist(StorageLevel.MEMORY_AND_DISK)
    total = cumulative(at_risk, "time", ["g"], sums={"baseline_hazard": "dh"}, force_two_level=two_level, n_buckets=n_buckets)
    base = total.select("g", "time", "baseline_hazard", F.exp(-F.col("baseline_hazard")).alias("baseline_survival"))
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    if two_level:
        base.count()
        tt.unpersist()
        at_risk.unpersist()
    for k, m in models.items():
        m.baseline = base.where(F.col("g") == F.lit(k)).drop("g")
