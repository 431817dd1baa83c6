"""One surface over every model (the reference's model base class + factory).

``make_model(kind, **params)`` returns a ``SurvivalEstimator`` with
``fit(df, time, event, features, id_col)``, ``predict_risk``,
``predict_survival``, ``predict_median``, ``feature_importance`` and
``summary``.  Enum-only kinds map to their nearest implementation:
weibull_aft -> aft, boosted_cox -> gradient_boosting, deephit -> neural
discrete.  Unknown kinds raise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.medians import event_times, first_at_level

ALIASES = {"cox": "cox_ph", "weibull_aft": "aft", "boosted_cox": "gradient_boosting",
           "deephit": "neural_discrete", "xgboost": "gradient_boosting", "lightgbm": "gradient_boosting"}
KINDS = ("kaplan_meier", "cox_ph", "aft", "aalen_additive", "frailty", "gradient_boosting",
         "random_survival_forest", "deepsurv", "neural", "neural_discrete", "bayesian", "competing_risks", "multi_state")


class SurvivalEstimator:
    def __init__(self, kind: str, **params):
        kind = ALIASES.get(kind, kind)
        if kind not in KINDS:
            raise ValueError(f"unknown model type {kind!r}")
        self.kind = kind
        self.params = params
        self.model = None
        self.features: list[str] = []
        self.id_col = "id"

    def get_model_type(self) -> str:
        return self.kind

    # ---- fit ----------------------------------------------------------------
    def fit(self, df: DataFrame, time: str, event: str, features: Sequence[str], id_col: str = "id"):
        self.features, self.id_col, self.time, self.event = list(features), id_col, time, event
        p = dict(self.params)
        if self.kind in ("random_survival_forest", "bayesian"):
            self._event_times = event_times(df, time, event).persist()
        k = self.kind
        if k == "kaplan_meier":
            from eventide.operators.risk import kaplan_meier
            self.model = kaplan_meier(df, time, event, p.get("stratify_by")).persist()
        elif k == "cox_ph":
            from eventide.operators.cox import cox_fit
            self.model = cox_fit(df, time, event, features, penalizer=p.get("penalizer", p.get("alpha", 0.0)),
                                 l1_ratio=p.get("l1_ratio", 0.0), ties=p.get("ties", "efron"))
        elif k == "aft":
            from eventide.operators.aft import aft_fit
            self.model = aft_fit(df, time, event, features, p.get("dist", "weibull"), p.get("penalizer", p.get("alpha", 0.0)),
                                 l1_ratio=p.get("l1_ratio", 0.0))
        elif k == "aalen_additive":
            from eventide.operators.additive import aalen_additive_fit
            self.model = aalen_additive_fit(df, time, event, features, p.get("coef_penalizer", 0.5))
        elif k == "frailty":
            from eventide.operators.frailty import frailty_fit
            self.model = frailty_fit(df, time, event, features, p.get("cluster"), max_em=p.get("max_em", 30))
        elif k == "gradient_boosting":
            from eventide.operators.boost import boost_fit
            self.model = boost_fit(df, time, event, features, id_col, p.get("n_estimators", 100),
                                   p.get("learning_rate", 0.1), p.get("max_depth", 3), p.get("subsample", 1.0),
                                   p.get("seed", 42))
        elif k == "random_survival_forest":
            from eventide.operators.forest import rsf_fit
            self.model = rsf_fit(df, time, event, features, id_col, **p)
        elif k == "deepsurv":
            from eventide.operators.neural import deepsurv_fit
            self.model = deepsurv_fit(df, time, event, features, id_col, **p)
        elif k == "neural":
            from eventide.operators.neural import neural_fit
            self.model = neural_fit(df, time, event, features, id_col, **p)
        elif k == "neural_discrete":
            from eventide.operators.neural import discrete_fit
            self.model = discrete_fit(df, time, event, features, **p)
        elif k == "bayesian":
            from eventide.operators.bayes import bayes_fit
            self.model = bayes_fit(df, time, event, features, id_col, **p)
        elif k == "competing_risks":
            # the cause column (0: censored) carries the events; ``event`` marks the cause of interest
            from eventide.operators import competing as C
            self.cause, self.interest = p.get("cause", "cause"), int(p.get("cause_of_interest", 1))
            if p.get("method", "cause_specific") == "fine_gray":
                self.model = C.fine_gray_fit(df, time, self.cause, features, self.interest)
            else:
                self.model = C.cause_specific_fit(df, time, self.cause, features, penalizer=p.get("penalizer", 0.0))
        elif k == "multi_state":
            from eventide.operators.multistate import multi_state_fit
            self.state = p.get("state", "state")
            self.model = multi_state_fit(df, features, self.state, p.get("next_state", "next_state"), time,
                                         p.get("penalizer", 0.1), p.get("risk_set", "all"))
        return self

    @property
    def _cause_specific(self) -> bool:
        return isinstance(self.model, dict)

    # ---- predict ------------------------------------------------------------
    def predict_risk(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep..., risk (higher = earlier event)."""
        k, m, keep = self.kind, self.model, list(keep)
        if k == "kaplan_meier":
            return df.select(*keep, F.lit(0.0).alias("risk"))
        if k in ("cox_ph",):
            return m.predict_risk(df).select(*keep, "risk")
        if k == "competing_risks":  # partial (or subdistribution) hazard of the cause of interest
            lp = m[self.interest].linear_predictor(df) if self._cause_specific else m.linear_predictor()
            return df.withColumn("risk", F.exp(lp)).select(*keep, "risk")
        if k == "multi_state":
            r = m.predict(df, self.id_col, self.state).select(F.col(self.id_col).alias("_id"), "risk")
            return df.select(*keep, F.col(self.id_col).alias("_id")).join(r, "_id").select(*keep, "risk")
        if k == "aft":
            return m.predict(df).select(*keep, "risk")
        if k == "aalen_additive":
            from eventide.operators.additive import additive_risk
            return additive_risk(m, df, keep)
        if k == "frailty":
            return m.predict_risk(df).select(*keep, "risk")
        if k in ("gradient_boosting", "deepsurv", "neural", "random_survival_forest", "bayesian"):
            return m.score(df, keep).select(*keep, "risk")
        if k == "neural_discrete":
            return m.predict_risk(df, self.id_col).select(*keep, "risk") if keep == [self.id_col] else \
                df.select(*keep, self.id_col).join(m.predict_risk(df, self.id_col), self.id_col).select(*keep, "risk")
        raise ValueError(k)

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        """Long table keep..., time, survival at the requested times only."""
        k, m, keep = self.kind, self.model, list(keep)
        times = [float(t) for t in times]
        if k == "kaplan_meier":
            from eventide.operators.risk import survival_at
            strata = self.params.get("stratify_by")
            if strata:  # strata x times rows: joined by stratum
                s = survival_at(m, times, strata, cols=["survival"])
                s = s.select(F.col(strata).alias("_st"), "time", F.coalesce("survival", F.lit(1.0)).alias("survival"))
                return df.select(*keep, F.col(strata).alias("_st")).join(s, "_st").select(*keep, "time", "survival")
            s = survival_at(m, times, cols=["survival"])
            vals = {r["time"]: r["survival"] for r in s.collect()}  # one value per requested time
            grid = F.explode(F.array(*[F.struct(F.lit(t).alias("time"), F.lit(vals[t]).alias("survival"))
                                       for t in times])).alias("g")
            return df.select(*keep, grid).select(*keep, "g.time", "g.survival")
        if k in ("cox_ph", "aft", "gradient_boosting", "deepsurv", "neural", "random_survival_forest",
                 "bayesian"):
            return m.predict_survival(df, times, keep)
        if k == "aalen_additive":
            return m.predict_cumulative_hazard(df, times, keep).select(*keep, "time", "survival")
        if k in ("competing_risks", "multi_state"):
            out = self._joint_survival(df, times).withColumnRenamed(self.id_col, "_id")
            return df.select(*keep, F.col(self.id_col).alias("_id")).join(out, "_id").select(*keep, "time", "survival")
        if k == "frailty":
            return m.predict_survival(df, times, keep)
        if k == "neural_discrete":
            from eventide.operators.lookup import step_lookup
            s = m.predict_survival(df, self.id_col).select(self.id_col, "time", "survival")
            pts = df.select(self.id_col, *[c for c in keep if c != self.id_col],
                            F.explode(F.array(*[F.lit(t) for t in times])).alias("time"))
            out = step_lookup(s, pts, [self.id_col], "time", ["survival"], defaults={"survival": 1.0})
            return out.select(*keep, "time", "survival")
        raise ValueError(k)

    def _joint_survival(self, df: DataFrame, times: Sequence[float]) -> DataFrame:
        """(id, time, survival): free of the cause of interest (Fine-Gray), of every cause, or still in the state."""
        m, key = self.model, self.id_col
        if self.kind == "multi_state":
            s = m.predict_survival(df, key, times, self.state)
            return s.groupBy(key, "time").agg(F.product("survival").alias("survival"))
        if self._cause_specific:
            from eventide.operators.competing import cause_specific_cif
            return cause_specific_cif(m, df, times, key).select(key, "time", "survival")
        return m.predict_cif(df, times, [key]).select(key, "time", (1.0 - F.col("cif")).alias("survival"))

    def predict_median(self, df: DataFrame, key: str) -> DataFrame:
        k, m = self.kind, self.model
        if k == "multi_state":
            return m.predict(df, key, self.state).select(key, "median_time")
        if k == "kaplan_meier" and self.params.get("stratify_by"):
            from eventide.operators.risk import median_survival
            strata = self.params["stratify_by"]
            return df.select(key, strata).join(median_survival(m, strata), strata, "left").select(key, "median_time")
        if k == "kaplan_meier":
            from eventide.operators.risk import median_survival
            med = median_survival(m).first()[0]
            return df.select(key, F.lit(med).alias("median_time"))
        if k == "cox_ph":
            return m.predict_median(df, key)
        if k == "aft":
            return m.predict(df).select(key, "median_time")
        if k == "neural_discrete":
            return m.predict_risk(df, key).select(key, "median_time")
        if k in ("gradient_boosting", "deepsurv", "frailty") or k == "neural" and m.loss == "cox":
            from eventide.operators.cox import median_from_baseline
            base = m.cox.baseline if k == "frailty" else m.baseline
            return median_from_baseline(base, self.predict_risk(df, [key]), key)
        if k == "aalen_additive":
            from eventide.operators.additive import additive_risk
            return additive_risk(m, df, [key], never=math.inf).select(key, "median_time")
        if k == "neural":  # Weibull: S(t) = exp(-(t / e^f)^k)
            return m.score(df, [key]).select(key, (F.exp("f") * math.log(2.0) ** math.exp(-m.log_shape)).alias("median_time"))
        if k == "competing_risks" and self._cause_specific:
            from eventide.operators.competing import cause_specific_median
            return cause_specific_median(m, df, key)
        if k == "competing_risks":  # 1 - CIF = exp(-H0 exp(lp))
            from eventide.operators.cox import median_from_baseline
            return median_from_baseline(m.baseline, self.predict_risk(df, [key]), key)
        x = df.select(key, *[f for f in self.features if f != key])
        return first_at_level(x, key, self._event_times, m.survival_at)

    def feature_importance(self, spark) -> DataFrame:
        k, m = self.kind, self.model
        if k == "kaplan_meier":
            return spark.createDataFrame([], "feature string, importance double")
        if k == "cox_ph":
            return m.importance(spark).select("feature", "importance")
        if k == "frailty":
            return m.cox.importance(spark).select("feature", "importance")
        if k == "aft":
            return m.importance(spark).select("feature", "importance")
        if k == "multi_state":
            return m.importance(spark)
        if k == "competing_risks":
            coefs = m[self.interest].coefficients(spark) if self._cause_specific else m.coefficients(spark)
            return coefs.select("feature", F.abs("coef").alias("importance")).orderBy(F.col("importance").desc(), "feature")
        if k in ("aalen_additive", "gradient_boosting", "random_survival_forest", "bayesian"):
            return m.importance(spark)
        if k in ("deepsurv", "neural"):
            raise ValueError("neural importance needs data: use gradient_importance(df) or permutation_importance")
        raise ValueError(k)

    def summary(self) -> dict:
        m = self.model
        if hasattr(m, "summary") and callable(m.summary):
            try:
                return m.summary()
            except TypeError:
                return {}
        return {"kind": self.kind}


def make_model(kind: str, **params) -> SurvivalEstimator:
    return SurvivalEstimator(kind, **params)
