"""Multi-state models: one Cox model per observed transition.

Default risk set: every row in the origin state is at risk for each exit of
that state; moves to another destination count as censored for this one.
``risk_set="taken_only"`` keeps only rows that took the transition.  All
transitions are fitted together over rows sorted once (``cox_sorted``): the exits of a
state share its rows, so rows are not copied once an exit and no table of times is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.cox import CoxModel
from eventide.operators.cox_grouped import MAX_GROUPS, _beta_map
from eventide.operators.cox_sorted import newton, sorted_rows
from eventide.operators.lookup import step_lookup

SEP = "->"
#: Event times of all transitions together whose hazards may go to every task at prediction (two numbers each).
CURVE_STEPS = 4_000_000


@dataclass
class MultiStateModel:
    features: list[str]
    models: dict = field(default_factory=dict)  # "from->to" -> CoxModel
    states: list = field(default_factory=list)
    _rows = None  # (sorted rows, standardised coefficients, transitions) of the fit; not a field, so it is not saved

    def transitions(self) -> list[tuple[str, str]]:
        return [tuple(k.split(SEP, 1)) for k in self.models]

    def coefficients(self, spark) -> DataFrame:
        out = None
        for k, m in sorted(self.models.items()):
            a, b = k.split(SEP, 1)
            c = m.coefficients(spark).select(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), "*")
            out = c if out is None else out.unionByName(c)
        return out

    def importance(self, spark) -> DataFrame:
        """Mean |coef| over transitions."""
        return self.coefficients(spark).groupBy("feature").agg(F.avg(F.abs("coef")).alias("importance"))

    def concordance(self, df: DataFrame, state: str = "state", next_state: str = "next_state",
                    time: str = "t") -> DataFrame:
        """c-index per transition (rows in the origin state, event = took this transition),
        all transitions in one grouped concordance job."""
        from eventide.operators.concordance import concordance_by
        spark = df.sparkSession
        p = len(self.features)
        betas = {k: m.coef for k, m in self.models.items()}
        means = {k: m.means for k, m in self.models.items()}
        bvec = F.element_at(_beta_map(betas, p), F.col("tr"))
        mvec = F.element_at(_beta_map(means, p), F.col("tr"))
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + (F.col(f).cast("double") - mvec[j]) * bvec[j]
        x = (df.select(F.col(state).alias("state"), F.col(next_state).alias("_n"), time, *self.features)
             .join(F.broadcast(self._edges(spark)), "state", "inner")  # one row per transition
             .withColumn("risk", lp).withColumn("_ev", F.coalesce(F.col("_n") == F.col("to_state"), F.lit(False))
                                                .cast("int")))
        return concordance_by(x, ["tr"], time, "_ev", "risk").select(F.col("tr").alias("transition"), "c_index")

    def summary(self, df: DataFrame | None = None) -> dict:
        ll = sum(m.loglik for m in self.models.values())
        k = sum(len(m.features) for m in self.models.values())
        out = {"states": len(self.states), "transitions": len(self.models),
               "n": sum(m.n for m in self.models.values()),
               "events": sum(m.events for m in self.models.values()),
               "log_likelihood": ll, "aic": -2 * ll + 2 * k}
        if df is not None:
            cs = [r["c_index"] for r in self.concordance(df).collect() if r["c_index"] == r["c_index"]]
            out["c_index"] = sum(cs) / len(cs) if cs else float("nan")
        return out

    def _edges(self, spark) -> DataFrame:
        rows = [(a, b, f"{a}{SEP}{b}") for a, b in self.transitions()]
        return spark.createDataFrame(rows, "state string, to_state string, tr string")

    def predict(self, df: DataFrame, key: str, state: str = "state") -> DataFrame:
        """risk = max partial hazard over exits of the current state;
        median = earliest median over those exits (NaN if none reached)."""
        spark = df.sparkSession
        p = len(self.features)
        any_m = next(iter(self.models.values()))
        betas = {k: m.coef for k, m in self.models.items()}
        means = {k: m.means for k, m in self.models.items()}
        bvec = F.element_at(_beta_map(betas, p), F.col("tr"))
        mvec = F.element_at(_beta_map(means, p), F.col("tr"))
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + (F.col(f).cast("double") - mvec[j]) * bvec[j]
        if self._rows is not None and sum(m.events for m in self.models.values()) <= CURVE_STEPS:
            return self._predict_held(df, key, state)
        edges = F.broadcast(self._edges(spark))  # bounded: one row per transition
        x = df.select(key, F.col(state).alias("state"), *self.features).join(edges, "state", "inner") \
            .withColumn("risk", F.exp(lp))
        # per transition: first time with H0(t) >= ln2 / risk
        base = None
        for k, m in self.models.items():
            b = m.baseline.select(F.lit(k).alias("tr"), (-F.col("baseline_hazard")).alias("nh"),
                                  F.col("time").alias("mt"))
            base = b if base is None else base.unionByName(b)
        base = base.groupBy("tr", "nh").agg(F.min("mt").alias("mt"))
        pts = x.select(key, "tr", "risk", (-F.lit(math.log(2.0)) / F.col("risk")).alias("nh"))
        med = step_lookup(base, pts, ["tr"], "nh", ["mt"])
        _ = any_m
        return med.groupBy(key).agg(F.max("risk").alias("risk"),
                                    F.coalesce(F.min("mt"), F.lit(float("nan"))).alias("median_time"))

    def _predict_held(self, df: DataFrame, key: str, state: str) -> DataFrame:
        """``predict`` with the hazards at all event times sent to every task: a row answers for all its exits where it is."""
        import pyarrow as pa
        rows, betas, names = self._rows
        curves, feats, exits = rows.curves(betas), [f"_x{j}" for j in range(len(self.features))], {}
        for m, (a, d) in enumerate(names):
            if m in betas:
                model = self.models[f"{a}{SEP}{d}"]
                exits.setdefault(a, []).append((np.asarray(model.means, float), np.asarray(model.coef, float), *curves[m]))
        held = df.sparkSession.sparkContext.broadcast(exits)

        def answer(batches):
            for b in batches:
                states = b.column("_state").dictionary_encode()
                code, called = states.indices.fill_null(-1).to_numpy(), states.dictionary.to_pylist()
                x = [b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in feats]
                known = np.ones(b.num_rows, bool)
                for c in feats:
                    known &= np.asarray(b.column(c).is_valid())
                risk, median, has = np.full(b.num_rows, -np.inf), np.full(b.num_rows, np.inf), np.zeros(b.num_rows, bool)
                for i, s in enumerate(called):
                    at = np.flatnonzero(code == i)
                    for means, coef, times, hazard in held.value.get(s, []):
                        has[at] = True
                        lp = np.zeros(len(at))
                        for v, mean, c in zip(x, means, coef, strict=True):
                            lp += (v[at] - mean) * c
                        r = np.exp(lp)
                        risk[at] = np.maximum(risk[at], r)
                        place = np.searchsorted(hazard, math.log(2.0) / r, side="left")
                        median[at] = np.minimum(median[at], np.append(times, np.inf)[place])
                some = np.flatnonzero(has)
                never = ~known | ~np.isfinite(median)
                yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(some)), pa.array(risk[some], mask=~known[some]),
                                                  pa.array(median[some], mask=never[some])], names=["_key", "risk", "mt"])

        x = df.select(F.col(key).alias("_key"), F.col(state).cast("string").alias("_state"),
                      *[F.col(f).cast("double").alias(c) for f, c in zip(self.features, feats)])
        med = x.mapInArrow(answer, f"_key {x.schema['_key'].dataType.simpleString()}, risk double, mt double")
        return med.groupBy(F.col("_key").alias(key)).agg(F.max("risk").alias("risk"), F.coalesce(F.min("mt"), F.lit(float("nan"))).alias("median_time"))

    def predict_survival(self, df: DataFrame, key: str, times: Sequence[float], state: str = "state") -> DataFrame:
        """S per exit transition of the current state at the requested times, in one pass:
        rows join their exits (broadcast edge list), coefficients come from a map literal and
        H0(t) of every transition from one aggregate over the baselines."""
        spark = df.sparkSession
        p = len(self.features)
        if self._rows is not None:
            rows, betas, names = self._rows
            reached = [(f"{names[m][0]}{SEP}{names[m][1]}", *h) for m, h in rows.hazard_at(betas, times).items()]
            h0 = spark.createDataFrame(reached, ", ".join(["tr string", *[f"h{i} double" for i in range(len(times))]]))
        else:
            base = None
            for k, m in self.models.items():
                b = m.baseline.select(F.lit(k).alias("tr"), "time", "baseline_hazard")
                base = b if base is None else base.unionByName(b)
            h0 = base.groupBy("tr").agg(*[F.max(F.when(F.col("time") <= float(t), F.col("baseline_hazard")))
                                          .alias(f"h{i}") for i, t in enumerate(times)])
        h0 = F.broadcast(h0)  # one row per transition (bounded by the fitted models)
        betas = {k: m.coef for k, m in self.models.items()}
        means = {k: m.means for k, m in self.models.items()}
        bvec = F.element_at(_beta_map(betas, p), F.col("tr"))
        mvec = F.element_at(_beta_map(means, p), F.col("tr"))
        lp = F.lit(0.0)
        for j, f in enumerate(self.features):
            lp = lp + (F.col(f).cast("double") - mvec[j]) * bvec[j]
        x = (df.select(key, F.col(state).alias("state"), *self.features)
             .join(F.broadcast(self._edges(spark)), "state", "inner").join(h0, "tr", "inner")
             .withColumn("_risk", F.exp(lp)))
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"),
                                            F.coalesce(F.col(f"h{i}"), F.lit(0.0)).alias("h"))
                                   for i, t in enumerate(times)])).alias("g")
        return x.select(key, F.col("tr").alias("transition"), "_risk", grid).select(
            key, "transition", F.col("g.time").alias("time"), F.exp(-F.col("g.h") * F.col("_risk")).alias("survival"))


def multi_state_fit(df: DataFrame, features: Sequence[str], state: str = "state",
                    next_state: str = "next_state", time: str = "t", penalizer: float = 0.1,
                    risk_set: str = "all", ties: str = "efron") -> MultiStateModel:
    """Fit one Cox per transition; transitions whose fit fails are skipped."""
    feats = list(features)
    p, xs = len(feats), [f"x{j}" for j in range(len(feats))]
    rows = df.select(F.col(state).cast("string").alias("_s"), F.col(next_state).cast("string").alias("_n"), F.col(time).cast("double").alias("t"),
                     *[F.col(f).cast("double").alias(x) for f, x in zip(feats, xs)]).persist(StorageLevel.MEMORY_AND_DISK)
    pairs = rows.groupBy("_s", "_n").agg(F.count(F.lit(1)).alias("rows"), *[f(x).alias(f"{c}_{x}") for x in xs for c, f in (
        ("n", F.count), ("m", F.avg), ("v", F.var_pop))]).collect()  # one row a pair of states
    edges = sorted({(r["_s"], r["_n"]) for r in pairs if r["_s"] is not None and r["_n"] is not None})
    if len(edges) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    taken = risk_set == "taken_only"
    strata = edges if taken else sorted({s for s, _ in edges})
    exits = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    # means and deviations over the rows at risk of every exit: a row counts once an exit
    counts = [(r, (1 if taken else exits[r["_s"]])) for r in pairs if r["_s"] in exits and (not taken or r["_n"] is not None)]
    means, scales = np.zeros(p), np.ones(p)
    for j, x in enumerate(xs):
        some = [(k * r[f"n_{x}"], r[f"m_{x}"], r[f"v_{x}"]) for r, k in counts if r[f"n_{x}"]]
        if some:
            n, m, v = np.array(some, float).T
            means[j] = n @ m / n.sum()
            scales[j] = math.sqrt(n @ (v + (m - means[j]) ** 2) / n.sum()) or 1.0
    place = {s: i for i, s in enumerate(strata)}
    label = {d: i for i, d in enumerate(sorted({d for _, d in edges}))}

    def numbered(column, of: dict):
        return F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), column)

    models: dict = {}
    out = MultiStateModel(feats, models, sorted({s for r in pairs for s in (r["_s"], r["_n"]) if s is not None}))
    if not edges:
        rows.unpersist()
        return out
    lab = F.coalesce(numbered(F.col("_n"), label), F.lit(-1))
    s = numbered(F.concat_ws(SEP, "_s", "_n"), {f"{a}{SEP}{d}": place[a, d] for a, d in edges}) if taken else numbered(F.col("_s"), place)
    known = F.col("_s").isNotNull() & F.col("_n").isNotNull() if taken else F.col("_s").isNotNull()
    x = rows.where(known).select(s.alias("s"), "t", lab.alias("lab"), *[((F.col(c) - float(m)) / float(v)).alias(c)
                                                                        for c, m, v in zip(xs, means, scales, strict=True)]).where("s IS NOT NULL")
    sorted_ = sorted_rows(x, p, sum(r["rows"] for r, _ in counts), [(place[(a, d) if taken else a], label[d], ties == "efron") for a, d in edges])
    rows.unpersist()
    fits = newton(sorted_.stats, range(len(edges)), p,
                  lambda m, b, n: (0.5 * n * penalizer * float(b @ b), n * penalizer * b, n * penalizer * np.eye(p)))
    betas, names = {}, {}
    for m, (beta, ll, null, info, n, events, steps) in fits.items():
        try:
            cov = np.linalg.inv(info)
        except np.linalg.LinAlgError:
            continue
        names[m] = f"{edges[m][0]}{SEP}{edges[m][1]}"
        betas[m] = beta
        models[names[m]] = CoxModel(feats, beta / scales, means, cov / np.outer(scales, scales), float(ll), float(null), n, events, steps, ties,
                                    penalizer, 0.0)
    if models:
        out._rows = (sorted_, betas, edges)
        # made when a baseline is first read
        base = sorted_.hazard_table(betas, names)
        for m, k in names.items():
            models[k].baseline = base.where(F.col("g") == F.lit(k)).drop("g")
    return out
