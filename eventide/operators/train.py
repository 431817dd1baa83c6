"""Training orchestration: evaluation, cross-validation, tuning, batch fits,
comparison and leaderboards (E08, E10-E14), batch prediction and permutation
importance (M23, M24).

Folds and trials are independent Spark jobs over one cached training table;
they are submitted from a small driver thread pool so the cluster runs them
side by side.  Trials of a Cox model share every pass over the rows (``_cox_trials``).
Every random choice is a hash of (seed, ...).
"""

from __future__ import annotations

import json
import math
import traceback
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from time import perf_counter as clock

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.exprs import hash_int
from eventide.operators import metrics as M
from eventide.operators.concordance import concordance, concordance_by
from eventide.operators.factory import ALIASES, make_model
from eventide.operators.split import kfold, stratified_split, uniform_rank

POOL = 4


def _tag_job(spark, name: str) -> None:
    """Concurrent folds/trials each get their own scheduler pool (used when
    spark.scheduler.mode=FAIR) and a readable job description."""
    sc = spark.sparkContext
    sc.setLocalProperty("spark.scheduler.pool", name)
    sc.setJobDescription(name)


def evaluate(est, test: DataFrame, time: str, event: str, id_col: str, grid_points: int = 100) -> dict:
    """c-index and integrated Brier score of a fitted estimator on a table."""
    r = est.predict_risk(test, [id_col, time, event])
    c = concordance(r, time, event, "risk")
    grid = M.brier_grid(test, time, event, grid_points)
    b = M.brier_of(est, test, grid, id_col, time, event).collect()
    ibs = M.integrate([(x["time"], x["brier"]) for x in b])
    return {"c_index": c["c_index"], "ibs": ibs, "n": test.count()}


def full_metrics(est, test: DataFrame, time: str, event: str, id_col: str, grid_points: int = 100, n_boot: int = 100,
                 seed: int = 42) -> tuple[dict, DataFrame]:
    """All metrics of a fitted estimator on a table: c-index with its bootstrap interval, integrated Brier
    score and AUC, seconds taken; and the table (time, brier, auc) at the evaluation times."""
    from eventide.operators.risk import kaplan_meier, survival_at
    began = clock()
    out = evaluate(est, test, time, event, id_col, grid_points)
    risks = est.predict_risk(test, [id_col, time, event]).persist(StorageLevel.MEMORY_AND_DISK)
    ci = M.bootstrap_ci(risks, id_col, time, event, "risk", n_boot, seed)
    times = [t for t in M.evaluation_times(test, time, event) if t > 0]
    brier = M.brier_of(est, test, times, id_col, time, event)
    auc = M.dynamic_auc(risks, times, "risk", time, event)
    at_times = test.sparkSession.createDataFrame(  # one row per evaluation time
        sorted(tuple(r) for r in brier.join(auc, "time", "full_outer").select("time", "brier", "auc").collect()),
        "time double, brier double, auc double")
    km = survival_at(kaplan_meier(test, time, event, with_ci=False), times, cols=["survival"])
    surv = {r["time"]: 1.0 if r["survival"] is None else r["survival"] for r in km.collect()}
    out |= {"c_index_lower": ci["lower"], "c_index_upper": ci["upper"],
            "integrated_auc": M.integrated_auc(at_times.select("time", "auc"), surv), "evaluation_seconds": clock() - began}
    risks.unpersist()
    return out, at_times


def cross_validate(df: DataFrame, kind: str, params: Mapping, time: str, event: str, features: Sequence[str],
                   id_col: str = "id", k: int = 5, seed: int = 42, grid_points: int = 100) -> DataFrame:
    """Per-fold metrics plus mean and population std of the c-index (fold = -1)."""
    spark = df.sparkSession
    data = kfold(df, k, id_col, seed).persist(StorageLevel.MEMORY_AND_DISK)

    def run(i):
        _tag_job(spark, f"cv-fold-{i}")
        tr, te = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
        est = make_model(kind, **params).fit(tr, time, event, features, id_col)
        m = evaluate(est, te, time, event, id_col, grid_points)
        return (i, float(m["c_index"]), float(m["ibs"]), int(m["n"]))

    with ThreadPoolExecutor(min(POOL, k)) as ex:
        rows = list(ex.map(run, range(k)))
    cs = [r[1] for r in rows]
    mean = sum(cs) / len(cs)
    std = math.sqrt(sum((c - mean) ** 2 for c in cs) / len(cs))
    rows.append((-1, mean, sum(r[2] for r in rows) / k, sum(r[3] for r in rows)))
    data.unpersist()
    out = spark.createDataFrame(rows, "fold int, c_index double, ibs double, n long")
    return out.withColumn("c_index_std", F.when(F.col("fold") == -1, F.lit(std)))


def sample_space(space: Mapping[str, tuple], n_trials: int, seed: int = 42) -> list[dict]:
    """Deterministic random search: ("float", lo, hi[, "log"]), ("int", lo, hi), ("categorical", [..]), ("bool",)."""
    import hashlib
    out = []
    for t in range(n_trials):
        cfg = {}
        for name, spec in sorted(space.items()):
            h = int(hashlib.md5(f"{seed}:{t}:{name}".encode()).hexdigest()[:8], 16) / 2 ** 32
            kind = spec[0]
            if kind == "float":
                lo, hi = spec[1], spec[2]
                cfg[name] = math.exp(math.log(lo) + h * (math.log(hi) - math.log(lo))) \
                    if len(spec) > 3 and spec[3] == "log" else lo + h * (hi - lo)
            elif kind == "int":
                cfg[name] = int(spec[1] + math.floor(h * (spec[2] - spec[1] + 1)))
            elif kind == "categorical":
                cfg[name] = spec[1][int(h * len(spec[1]))]
            else:
                cfg[name] = h < 0.5
        out.append(cfg)
    return out


def _cox_trials(tr: DataFrame, va: DataFrame, cfgs: Mapping[int, Mapping], time: str, event: str, features: Sequence[str], id_col: str,
                grid_points: int) -> dict:
    """{trial: (c_index, ibs, log likelihood)} of Cox models that differ in penalty and ties: Newton steps over rows sorted once,
    one concordance job and one Brier job for all.  Trials with other parameters, and all if a value is missing, are left out."""
    from eventide.operators.cox import _penalty, _standardised
    from eventide.operators.cox_sorted import newton, sorted_rows
    cfgs = {t: c for t, c in cfgs.items() if c.keys() <= {"penalizer", "alpha", "l1_ratio", "ties"} and c.get("ties", "efron") in ("efron", "breslow")}
    feats, spark, p = list(features), tr.sparkSession, len(features)
    usable = F.col(event).cast("int").isin(0, 1)
    for c in [time, *feats]:
        usable = usable & F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double"))
    if not cfgs or tr.where(~F.coalesce(usable, F.lit(False))).limit(1).count() or va.where(~F.coalesce(usable, F.lit(False))).limit(1).count():
        return {}
    rows = _standardised(tr, time, event, feats)
    x = rows.table.select(F.lit(0).alias("s"), "t", (F.col("e") - 1).alias("lab"), *[f"x{j}" for j in range(p)])  # label 0: the event
    trials = list(cfgs)
    sorted_ = sorted_rows(x, p, rows.n, [(0, 0, cfgs[t].get("ties", "efron") == "efron") for t in trials])
    lam = [float(cfgs[t].get("penalizer", cfgs[t].get("alpha", 0.0))) for t in trials]
    fits = newton(sorted_.stats, range(len(trials)), p, lambda m, b, n: _penalty(b, lam[m], cfgs[trials[m]].get("l1_ratio", 0.0), n) if lam[m] else
                  (0.0, np.zeros(p), np.zeros((p, p))), singular="pinv")
    grid = sorted(set(M.brier_grid(va, time, event, grid_points)))
    hazards = sorted_.hazard_at({m: f[0] for m, f in fits.items()}, grid)
    models = [(m, f[0] / rows.scales, np.array(hazards[m])) for m, f in fits.items()]
    means, names = rows.means, [f"_x{j}" for j in range(p)]
    numbers = [F.col(f).cast("double").alias(c) for f, c in zip(feats, names)]
    G = M.censoring_km(va, time, event)
    gh, at = np.array(M.g_at(G, grid)), np.array(grid)

    def risks(batch):
        """(model, hazard at the grid, risk of each row), summed in one order: equal rows get equal risks."""
        x = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        for m, coef, hazard in models:
            lp = np.zeros(batch.num_rows)
            for v, mean, c in zip(x, means, coef, strict=True):
                lp += (v - mean) * c
            yield m, hazard, np.exp(lp)

    def scored(batches):
        import pyarrow as pa
        for b in batches:
            for m, _, r in risks(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), m, np.int32)), b.column("_T"), b.column("_E"), pa.array(r)],
                                                 names=["m", "_T", "_E", "risk"])

    def errors(batches):
        import pyarrow as pa
        total, n = np.zeros((len(models), len(at))), 0
        for b in batches:
            T, E = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("_T", "_E"))
            g = b.column("_G_T").to_numpy(zero_copy_only=False).astype(float)
            past, n = (T <= at) & (E == 1), n + b.num_rows
            with np.errstate(divide="ignore", invalid="ignore"):
                case = np.where(g > 0, 1.0 / g, 0.0)[:, None] * past
                late = np.where(gh > 0, 1.0 / gh, 0.0) * (T > at)
            for i, (_, hazard, r) in enumerate(risks(b)):
                S = np.exp(-r[:, None] * hazard)
                total[i] += (S * S * case + (1.0 - S) ** 2 * late).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "v"])

    outcome = [F.col(time).cast("double").alias("_T"), F.col(event).cast("int").alias("_E")]
    long = va.select(*outcome, *numbers).mapInArrow(scored, "m int, _T double, _E int, risk double")
    c_index = {r["m"]: r["c_index"] for r in concordance_by(long, ["m"], "_T", "_E", "risk").collect()}
    joined = va.join(M.with_outcome(va, id_col, time, event, G), id_col, "inner")  # as in ``brier_of``
    found = joined.select(F.col("_T").cast("double").alias("_T"), F.col("_E").cast("int").alias("_E"), "_G_T", *numbers).mapInArrow(
        errors, "n double, v array<double>").collect()  # one row a task
    brier = sum(np.array(r["v"]).reshape(len(models), -1) for r in found) / sum(r["n"] for r in found)
    return {trials[m]: (float(c_index[m]), float(M.integrate(list(zip(grid, brier[i].tolist(), strict=True)))), float(fits[m][1]))
            for i, (m, _, _) in enumerate(models)}


def tune(df: DataFrame, kind: str, space: Mapping[str, tuple], time: str, event: str, features: Sequence[str],
         id_col: str = "id", objective: str = "c_index", n_trials: int = 50, seed: int = 42,
         base_params: Mapping | None = None, grid_points: int = 100) -> DataFrame:
    """Trials table (trial, params, c_index, ibs, objective, error) ordered best first.

    Objectives: c_index (maximise), ibs (minimise), log_likelihood (maximise, Cox-type only).
    """
    spark = df.sparkSession
    tr, va = stratified_split(df, event, id_col, 0.2, seed)
    tr = tr.persist(StorageLevel.MEMORY_AND_DISK)
    va = va.persist(StorageLevel.MEMORY_AND_DISK)
    cfgs = sample_space(space, n_trials, seed)

    def run(t):
        _tag_job(spark, f"trial-{t}")
        cfg = {**(base_params or {}), **cfgs[t]}
        try:
            est = make_model(kind, **cfg).fit(tr, time, event, features, id_col)
            m = evaluate(est, va, time, event, id_col, grid_points)
            ll = getattr(est.model, "loglik", None)
            obj = {"c_index": m["c_index"], "ibs": m["ibs"], "log_likelihood": ll}[objective]
            return (t, json.dumps(cfgs[t]), float(m["c_index"]), float(m["ibs"]),
                    None if obj is None else float(obj), None)
        except Exception as ex:  # noqa: BLE001 — a failed trial is recorded, not fatal
            return (t, json.dumps(cfgs[t]), None, None, None, f"{type(ex).__name__}: {ex}"[:500])

    together = {}
    if ALIASES.get(kind, kind) == "cox_ph":
        try:
            together = _cox_trials(tr, va, {t: {**(base_params or {}), **c} for t, c in enumerate(cfgs)}, time, event, features, id_col, grid_points)
        except Exception:  # noqa: BLE001 — a trial that fails is found, and recorded, by itself
            together = {}
    rows = [(t, json.dumps(cfgs[t]), c, ibs, {"c_index": c, "ibs": ibs, "log_likelihood": ll}[objective], None) for t, (c, ibs, ll) in together.items()]
    with ThreadPoolExecutor(POOL) as ex:
        rows = sorted([*rows, *ex.map(run, [t for t in range(n_trials) if t not in together])])
    out = spark.createDataFrame(rows, "trial int, params string, c_index double, ibs double, "
                                      "objective double, error string")
    order = F.col("objective").asc_nulls_last() if objective == "ibs" else F.col("objective").desc_nulls_last()
    return out.orderBy(order, "trial")


def fit_many(df: DataFrame, configs: Sequence[Mapping], time: str, event: str, features: Sequence[str],
             id_col: str = "id", test: float = 0.25, seed: int = 42, grid_points: int = 100) -> DataFrame:
    """Fit several configurations; failures are recorded with their error and skipped."""
    spark = df.sparkSession
    tr, te = stratified_split(df, event, id_col, test, seed)
    tr = tr.persist(StorageLevel.MEMORY_AND_DISK)
    te = te.persist(StorageLevel.MEMORY_AND_DISK)

    def run(i):
        _tag_job(spark, f"fit-{i}")
        cfg = dict(configs[i])
        name = cfg.pop("name", f"model_{i}")
        kind = cfg.pop("kind")
        try:
            est = make_model(kind, **cfg).fit(tr, time, event, features, id_col)
            m = evaluate(est, te, time, event, id_col, grid_points)
            return (name, kind, float(m["c_index"]), float(m["ibs"]), None)
        except Exception as ex:  # noqa: BLE001
            return (name, kind, None, None, f"{type(ex).__name__}: {ex}"[:500] or traceback.format_exc()[-500:])

    with ThreadPoolExecutor(POOL) as ex:
        rows = list(ex.map(run, range(len(configs))))
    return spark.createDataFrame(rows, "model string, kind string, c_index double, ibs double, error string")


def compare(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Rank by c-index (desc) and IBS (asc); missing values are unranked; ties by model id."""
    out = metrics
    for col, asc in (("c_index", False), ("ibs", True)):
        if col not in metrics.columns:
            continue
        o = F.col(col).asc() if asc else F.col(col).desc()
        w = Window.partitionBy(F.col(col).isNull()).orderBy(o, F.col(model))  # few rows: one per model
        out = out.withColumn(f"{col}_rank", F.when(F.col(col).isNotNull(), F.rank().over(w)))
    return out


def leaderboard(metrics: DataFrame, metric: str = "c_index", model: str = "model") -> DataFrame:
    """Models with the metric present, best first (IBS ascending, others descending)."""
    o = F.col(metric).asc() if metric == "ibs" else F.col(metric).desc()
    return metrics.where(F.col(metric).isNotNull()).orderBy(o, F.col(model))


def _split(df: DataFrame, config: Mapping, event: str, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: by the given id tables (``train_ids``, ``test_ids``; one alone leaves the
    rest to the other), else stratified by event."""
    ids = {k: config[k].select(F.col(id_col)).distinct() for k in ("train_ids", "test_ids") if config.get(k) is not None}
    if not ids:
        return stratified_split(df, event, id_col, config.get("test_size", 0.2), seed)
    take = lambda k, other: df.join(ids[k], id_col, "left_semi") if k in ids else df.join(ids[other], id_col, "left_anti")
    return take("train_ids", "test_ids"), take("test_ids", "train_ids")


def train(df: DataFrame, config: Mapping, time: str, event: str, features: Sequence[str],
          id_col: str = "id") -> dict:
    """Split -> (tune) -> (cross-validate) -> fit -> evaluate -> importance.

    ``config``: kind, params, test_size or train_ids / test_ids (DataFrames of ids), cv (folds), space and
    n_trials (tuning), grid_points, n_boot, seed.  Returns the estimator and tables: metrics, metrics at
    the evaluation times, importance, trials, cross-validation.
    """
    spark = df.sparkSession
    seed = config.get("seed", 42)
    tr, te = _split(df, config, event, id_col, seed)
    tr = tr.persist(StorageLevel.MEMORY_AND_DISK)
    te = te.persist(StorageLevel.MEMORY_AND_DISK)
    params = dict(config.get("params", {}))
    trials = None
    if config.get("space"):
        trials = tune(tr, config["kind"], config["space"], time, event, features, id_col,
                      config.get("objective", "c_index"), config.get("n_trials", 50), seed, params)
        best = trials.where(F.col("error").isNull()).first()
        if best is not None:
            params.update(json.loads(best["params"]))
    folds = cross_validate(tr, config["kind"], params, time, event, features, id_col, int(config["cv"]), seed,
                           config.get("grid_points", 100)) if config.get("cv") else None
    began = clock()
    est = make_model(config["kind"], **params).fit(tr, time, event, features, id_col)
    seconds = clock() - began
    m, at_times = full_metrics(est, te, time, event, id_col, config.get("grid_points", 100), config.get("n_boot", 100), seed)
    metrics = spark.createDataFrame(
        [(config["kind"], *(None if m[c] is None else float(m[c]) for c in ("c_index", "c_index_lower", "c_index_upper", "ibs", "integrated_auc")),
          int(m["n"]), seconds, m["evaluation_seconds"])],
        "kind string, c_index double, c_index_lower double, c_index_upper double, ibs double, integrated_auc double, n_test long, "
        "training_seconds double, evaluation_seconds double")
    try:
        imp = est.feature_importance(spark)
    except ValueError:
        imp = permutation_importance(est, te, features, id_col, seed=seed)
    tr.unpersist()
    te.unpersist()
    return {"model": est, "metrics": metrics, "at_times": at_times, "importance": imp, "trials": trials, "folds": folds, "params": params}


def predict_batch(est, df: DataFrame, key: str, times: Sequence[float]) -> DataFrame:
    """Risk, median and survival at the requested times for any rows (one row per key)."""
    r = est.predict_risk(df, [key])
    med = est.predict_median(df, key)
    s = est.predict_survival(df, times, [key])
    wide = s.groupBy(key).agg(*[F.max(F.when(F.col("time") == float(t), F.col("survival"))).alias(f"S_{i}")
                                for i, t in enumerate(times)])
    return r.join(med, key).join(wide, key)


def permutation_importance(est, df: DataFrame, features: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Mean |risk(shuffled feature) - risk| per feature, on real rows.

    The shuffle pairs each row with the row of the same rank under a second
    hash order: both ranks come from ``uniform_rank`` (two-level, no global
    window) and are joined on the rank — a distributed permutation.
    """
    spark = df.sparkSession
    base = est.predict_risk(df, [key]).withColumnRenamed("risk", "_r0")
    ranked = uniform_rank(df.withColumn("_k0", hash_int(seed, F.col(key))), "_k0", key) \
        .withColumnRenamed("rank", "_rank").drop("_k0").persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    for j, f in enumerate(features):
        donor = uniform_rank(df.select(key, f).withColumn("_k1", hash_int(f"{seed}:{f}", F.col(key))), "_k1", key)
        donor = donor.select(F.col("rank").alias("_rank"), F.col(f).alias("_perm"))
        shuffled = ranked.join(donor, "_rank").withColumn(f, F.col("_perm")).drop("_perm", "_rank")
        r1 = est.predict_risk(shuffled, [key]).withColumnRenamed("risk", "_r1")
        v = base.join(r1, key).agg(F.avg(F.abs(F.col("_r1") - F.col("_r0")))).first()[0]
        rows.append((f, float(v)))
    ranked.unpersist()
    return spark.createDataFrame(rows, "feature string, importance double")


