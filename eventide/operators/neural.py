"""Neural survival models.

* ``deepsurv_fit`` / ``neural_fit(loss="cox")``: an MLP scores rows; the Cox
  partial-likelihood gradient w.r.t. each score is E_i - e^{f_i} A(T_i) from
  the Breslow time table (the same quantity as the Cox and boosting fits);
  each task back-propagates it through the network for its rows and Spark sums
  the per-partition gradients; Adam runs on the driver.  Full batch; early
  stopping on a hash-held-out fold.
* ``neural_fit(loss="parametric")``: the network gives log lambda(x) of a
  Weibull with a shared shape k; same gradient loop with the Weibull
  likelihood.  risk = -E[T] = -lambda Gamma(1 + 1/k).
* ``neural_fit(loss="discrete")``: person-period rows (one per subject and
  interval lived) and Spark ML's ``MultilayerPerceptronClassifier`` on
  (x, interval one-hot); S = prod (1 - h).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import mlp
from eventide.functions.exprs import hash_unit
from eventide.functions.sums import KeyedSums, columns
from eventide.operators.features import time_bins
from eventide.plans.scan import BROADCAST_MAX_ROWS, ROWS_PER_BUCKET, SINGLE_WINDOW_MAX_ROWS, cumulative, right_size
from eventide.session import cut_lineage


@dataclass
class NeuralModel:
    features: list[str]
    hidden: list[int]
    loss: str
    theta: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    residual: bool = False
    log_shape: float = 0.0
    epochs: int = 0
    history: list = field(default_factory=list)
    baseline: DataFrame = field(repr=False, default=None)

    def _x(self, pdf):
        return _design(pdf, self.features, self.means, self.scales)

    def score(self, df: DataFrame, keep: Sequence[str] = (), dropout: float = 0.0, seed: int = 0) -> DataFrame:
        """f(x) and risk (exp f for cox; -E[T] for parametric).  Training passes ``dropout`` and a seed;
        the rows' masks then come from the kept column ``_rk``."""
        theta, hidden, res, loss, k = self.theta, self.hidden, self.residual, self.loss, math.exp(self.log_shape)
        feats, means, scales = list(self.features), self.means, self.scales
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        schema = (schema + ", " if schema else "") + "f double, risk double"

        def fn(it):
            for pdf in it:
                keys = pdf["_rk"].to_numpy() if dropout > 0 else None
                f, _ = mlp.forward(theta, _design(pdf, feats, means, scales), hidden, res, dropout, keys, seed)
                out = pdf[list(keep)].copy()
                out["f"] = f
                out["risk"] = np.exp(f) if loss == "cox" else -np.exp(f) * math.gamma(1 + 1 / k)
                yield out

        extra = [f for f in self.features if f not in keep]
        return df.select(*keep, *extra).mapInPandas(fn, schema)

    def gradient_importance(self, df: DataFrame) -> DataFrame:
        """Mean |d risk / d x| per feature (input gradients in each task)."""
        theta, hidden, res = self.theta, self.hidden, self.residual
        p = len(self.features)
        feats, means, scales = list(self.features), self.means, self.scales

        def fn(it):
            acc = np.zeros(p)
            n = 0
            for pdf in it:
                X = _design(pdf, feats, means, scales)
                f, cache = mlp.forward(theta, X, hidden, res)
                _, dx = mlp.backward(theta, X, hidden, cache, np.exp(f), res, need_input_grad=True)
                acc += np.abs(dx / scales).sum(0)
                n += len(pdf)
            yield pd.DataFrame({"g": [acc.tolist()], "n": [n]})

        part = df.select(*self.features).mapInPandas(fn, "g array<double>, n long")
        row = part.agg(*[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(p)], F.sum("n").alias("n")).first()
        spark = df.sparkSession
        return spark.createDataFrame([(f, float(row[f"g{j}"] / row["n"])) for j, f in enumerate(self.features)],
                                     "feature string, importance double")

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        sc = self.score(df, keep)
        grid = F.explode(F.array(*[F.lit(float(t)) for t in times])).alias("time")
        if self.loss == "cox":
            aggs = [F.max(F.when(F.col("time") <= float(t), F.col("baseline_hazard"))).alias(f"h{i}")
                    for i, t in enumerate(times)]
            row = self.baseline.agg(*aggs).first()
            hz = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(row[f"h{i}"] or 0.0))
                                              .alias("h0")) for i, t in enumerate(times)])).alias("g")
            x = sc.select(*keep, "f", hz)
            return x.select(*keep, F.col("g.time").alias("time"),
                            F.exp(-F.col("g.h0") * F.exp("f")).alias("survival"))
        k = math.exp(self.log_shape)
        x = sc.select(*keep, "f", grid)
        return x.select(*keep, "time", F.exp(-F.pow(F.col("time") / F.exp("f"), F.lit(k))).alias("survival"))


def _design(pdf, feats, means, scales):
    return (np.column_stack([pdf[f].to_numpy(dtype=float) for f in feats]) - means) / scales


def _scored_by_time(model: NeuralModel, data: DataFrame, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """(_val, time, d, S0p, ef): events, sum of e^f and sum of E f per time and fold at the model's parameters, added up
    in the tasks.  ``dropout`` applies to the training fold alone, with the rows' masks from ``_rk`` and the seed."""
    theta, hidden, res, feats = model.theta, model.hidden, model.residual, list(model.features)
    means, scales = model.means, model.scales
    names = ["_val", "time", "d", "S0p", "ef"]

    def packed(got):
        keys, sums = got
        time = pa.array(keys[1], from_pandas=True)  # a missing time stays missing
        return pa.RecordBatch.from_arrays([pa.array(keys[0] == 1.0), time, *[pa.array(v) for v in sums]], names)

    def fn(it):
        total = KeyedSums()
        for batch in it:
            if not batch.num_rows:
                continue
            val, t, e, *x = columns(batch, ["_val", "t", "e", *feats])
            X = (np.column_stack(x) - means) / scales
            f = np.empty(len(t))
            keys = batch.column("_rk").to_numpy(zero_copy_only=False)
            for fold, rate in ((0.0, dropout), (1.0, 0.0)):
                rows = val == fold
                if rows.any():
                    f[rows], _ = mlp.forward(theta, X[rows], hidden, res, rate, keys[rows] if rate > 0 else None, seed)
            e, w, ef = (np.where(np.isnan(v), 0.0, v) for v in (e, np.exp(f), e * f))
            got = total.add(np.stack([val, t]), np.stack([e, w, ef]))
            if got is not None:
                yield packed(got)
        got = total.rest()
        if got is not None:
            yield packed(got)

    parts = data.select("_rk", F.col("_val").cast("double").alias("_val"), "t", "e", *feats) \
        .mapInArrow(fn, "_val boolean, time double, d double, S0p double, ef double")
    return parts.groupBy("_val", "time").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _cox_time_table(by_time: DataFrame, n_times: int | None = None) -> tuple[DataFrame, int]:
    """Breslow sums A and log-likelihood terms L over the times of each fold, and the number of (fold, time) rows
    (counted unless given)."""
    if n_times is None:
        by_time = by_time.persist(StorageLevel.MEMORY_AND_DISK)
        n_times = by_time.count()
    two_level = n_times > SINGLE_WINDOW_MAX_ROWS
    how = {"force_two_level": two_level, "n_buckets": max(2, math.ceil(n_times / ROWS_PER_BUCKET))}
    if two_level:
        by_time = by_time.persist(StorageLevel.MEMORY_AND_DISK)
    tt = cumulative(by_time, "time", ["_val"], sums={"S0": "S0p"}, descending=True, **how)
    tt = tt.withColumn("dh", F.col("d") / F.col("S0")).withColumn(
        "L", F.when(F.col("d") > 0, F.col("d") * F.log("S0")).otherwise(0.0))
    return cumulative(tt, "time", ["_val"], sums={"A": "dh"}, **how), n_times


def neural_fit(df: DataFrame, time: str, event: str, features: Sequence[str], id_col: str,
               loss: str = "cox", hidden: Sequence[int] = (64, 32), arch: str = "mlp",
               learning_rate: float = 1e-2, l2: float = 1e-4, epochs: int = 50, dropout: float = 0.0,
               patience: int = 5, val_fraction: float = 0.1, seed: int = 42) -> NeuralModel:
    """M11/M12 (cox, parametric): full-batch training with Spark-summed gradients."""
    if loss == "discrete":
        raise ValueError("use discrete_fit for the discrete-time loss")
    feats = list(features)
    hidden = list(hidden)
    p = len(feats)
    st = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{j}") for j, f in enumerate(feats)],
                *[F.stddev_pop(F.col(f).cast("double")).alias(f"s{j}") for j, f in enumerate(feats)]).first()
    means = np.array([st[f"m{j}"] or 0.0 for j in range(p)])
    scales = np.array([st[f"s{j}"] or 1.0 for j in range(p)])
    scales = np.where(scales > 0, scales, 1.0)
    base = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_rk"), F.col(time).cast("double").alias("t"),
                     F.col(event).cast("int").alias("e"), *[F.col(f).cast("double").alias(f) for f in feats])
    base = base.withColumn("_val", hash_unit(f"val{seed}", F.col("_id")) < val_fraction)
    # read twice an epoch: held in columns beside the checkpoint
    base = cut_lineage(right_size(base)).drop("_id").persist(StorageLevel.MEMORY_AND_DISK)
    train, val = base.where(~F.col("_val")), base.where(F.col("_val"))
    residual = arch == "resnet"
    model = NeuralModel(feats, hidden, loss, mlp.init(p, hidden, seed), means, scales, residual)
    if loss == "parametric":
        # start the network at log lambda = mean log T (the output bias is the last parameter)
        model.theta[-1] = float(base.agg(F.avg(F.log("t"))).first()[0])
    opt = mlp.Adam(learning_rate)
    best, best_theta, best_k, bad = math.inf, model.theta.copy(), model.log_shape, 0
    n_train, n_val = train.count(), val.count()
    n_times = None

    def scores(fold, seed):
        """The Cox time table at the current parameters and, for training (False) and validation (True), the loss."""
        nonlocal n_times
        tt, n_times = _cox_time_table(_scored_by_time(model, fold, dropout, seed), n_times)
        tt = tt.persist(StorageLevel.MEMORY_AND_DISK)
        sums = tt.groupBy("_val").agg(F.sum("ef").alias("ef"), F.sum("L").alias("L")).collect()
        return tt, {r["_val"]: -float(r["ef"] or 0.0) + float(r["L"] or 0.0) for r in sums}

    if loss == "cox" and epochs:
        tt, losses = scores(base, seed)
    for ep in range(epochs):
        if loss == "cox":
            g, loss_tr = _cox_gradient(model, train, tt, n_times, dropout, seed + ep), losses.get(False, 0.0)
        else:
            g, loss_tr = _epoch_gradient(model, train, dropout, seed + ep)
        g = g / max(n_train, 1)
        if loss == "parametric":
            g[:-1] += l2 * model.theta
            both = opt.step(np.concatenate([model.theta, [model.log_shape]]), g)
            model.theta, model.log_shape = both[:-1], float(both[-1])
        else:
            model.theta = opt.step(model.theta, g + l2 * model.theta)
        if loss == "cox":  # one pass gives this epoch's validation loss and the next one's training sums
            tt.unpersist()
            tt, losses = scores(base if ep + 1 < epochs else val, seed + ep + 1)
            vloss = losses.get(True, 0.0) / max(n_val, 1)
        else:
            vloss = _loss_only(model, val)
        model.history.append((ep, loss_tr / max(n_train, 1), vloss))
        model.epochs = ep + 1
        if vloss < best - 1e-9:
            best, best_theta, best_k, bad = vloss, model.theta.copy(), model.log_shape, 0
        else:
            bad += 1
            if bad >= patience:
                break
    model.theta, model.log_shape = best_theta, best_k
    if loss == "cox":
        tt, _ = _cox_time_table(_scored_by_time(model, base.withColumn("_val", F.lit(False))))
        model.baseline = tt.select("time", F.col("A").alias("baseline_hazard")).persist(StorageLevel.MEMORY_AND_DISK)
    return model


def _cox_gradient(model: NeuralModel, data: DataFrame, tt: DataFrame, n_times: int, dropout: float, seed: int) -> np.ndarray:
    """Gradient of the training rows' negative partial log-likelihood; d(-loglik)/df_i = -(E_i - e^{f_i} A(T_i))."""
    theta, hidden, res, feats = model.theta, model.hidden, model.residual, list(model.features)
    means, scales = model.means, model.scales
    at = tt.where(~F.col("_val")).select(F.col("time").alias("_tt"), F.col("A").alias("_A"))
    at = F.broadcast(at) if n_times <= BROADCAST_MAX_ROWS else at
    j = data.join(at, data["t"] == at["_tt"], "inner").select("_rk", "e", "_A", *feats)

    def fn(it):
        acc = np.zeros(len(theta))
        for batch in it:
            if batch.num_rows:
                e, A, *x = columns(batch, ["e", "_A", *feats])
                X = (np.column_stack(x) - means) / scales
                keys = batch.column("_rk").to_numpy(zero_copy_only=False)
                f, cache = mlp.forward(theta, X, hidden, res, dropout, keys, seed)
                acc += mlp.backward(theta, X, hidden, cache, -(e - np.exp(f) * A), res)[0]
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["g"])

    parts = j.mapInArrow(fn, "g array<double>").collect()  # one row per partition: bounded by the partition count
    return np.sum([np.array(r["g"]) for r in parts], axis=0) if parts else np.zeros(len(theta))


def _epoch_gradient(model: NeuralModel, data: DataFrame, dropout: float, seed: int):
    """Gradient and loss of the Weibull likelihood (network parameters, then log shape)."""
    theta, hidden, res, feats = model.theta, model.hidden, model.residual, model.features
    k = math.exp(model.log_shape)
    npar = len(theta) + 1
    means, scales = model.means, model.scales

    def fn(it):
        acc = np.zeros(npar)
        tot = 0.0
        for pdf in it:
            X = _design(pdf, feats, means, scales)
            f, cache = mlp.forward(theta, X, hidden, res, dropout, pdf["_rk"].to_numpy(), seed)
            t = pdf["t"].to_numpy()
            e = pdf["e"].to_numpy().astype(float)
            z = np.exp(k * (np.log(t) - f))  # (t / lambda)^k
            tot += float(-(e * (math.log(k) - k * f + (k - 1) * np.log(t)) - z).sum())
            gout = e * k - k * z                       # d(-ll)/df
            gk = float((-(e * (1 + k * (np.log(t) - f))) + z * k * (np.log(t) - f)).sum())
            gp, _ = mlp.backward(theta, X, hidden, cache, gout, res)
            acc[:-1] += gp
            acc[-1] += gk
        yield pd.DataFrame({"g": [acc.tolist()], "l": [tot]})

    part = data.select("_rk", "t", "e", *feats).mapInPandas(fn, "g array<double>, l double")
    parts = part.collect()  # one row per partition: bounded by the partition count
    g = np.sum([np.array(r["g"]) for r in parts], axis=0) if parts else np.zeros(npar)
    return g, float(sum(r["l"] for r in parts))


def _loss_only(model: NeuralModel, data: DataFrame) -> float:
    feats = model.features
    sc = model.score(data.select("t", "e", *feats), ["t", "e"])
    n = max(data.count(), 1)
    k = math.exp(model.log_shape)
    z = F.exp(k * (F.log("t") - F.col("f")))
    ll = F.col("e") * (math.log(k) - k * F.col("f") + (k - 1) * F.log("t")) - z
    return -float(sc.agg(F.sum(ll)).first()[0]) / n


def deepsurv_fit(df, time, event, features, id_col, hidden=(64, 32), dropout=0.1, l2=1e-4,
                 learning_rate=1e-2, epochs=50, patience=5, seed=42) -> NeuralModel:
    """DeepSurv = MLP with the Cox partial likelihood (risk set T >= t, Breslow baseline)."""
    return neural_fit(df, time, event, features, id_col, "cox", hidden, "mlp", learning_rate, l2, epochs,
                      dropout, patience, 0.1, seed)


# ---- discrete-time model --------------------------------------------------

@dataclass
class DiscreteModel:
    features: list[str]
    n_bins: int
    edges: list[float]
    model: object = field(repr=False, default=None)

    def _design(self, df: DataFrame, period: F.Column) -> DataFrame:
        onehot = [(period == j).cast("double").alias(f"_p{j}") for j in range(1, self.n_bins + 1)]
        x = df.select("*", *onehot)
        return VectorAssembler(inputCols=self.features + [f"_p{j}" for j in range(1, self.n_bins + 1)],
                               outputCol="features", handleInvalid="keep").transform(x)

    def predict_survival(self, df: DataFrame, key: str) -> DataFrame:
        """S at the end of every interval: (key, period, time, hazard, survival)."""
        x = df.select(key, *self.features, F.explode(F.sequence(F.lit(1), F.lit(self.n_bins))).alias("period"))
        pr = self.model.transform(self._design(x, F.col("period")))
        h = pr.select(key, "period", vector_to_array("probability")[1].alias("hazard"))
        w = Window.partitionBy(key).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
        edges = F.array(*[F.lit(float(e)) for e in self.edges])
        return h.withColumn("survival", F.product(1.0 - F.col("hazard")).over(w)) \
                .withColumn("time", F.element_at(edges, F.col("period") + 1))

    def predict_risk(self, df: DataFrame, key: str) -> DataFrame:
        """risk = sum of interval hazards; median = first interval end with S <= 0.5 (+inf if never)."""
        s = self.predict_survival(df, key)
        return s.groupBy(key).agg(F.sum("hazard").alias("risk"),
                                  F.coalesce(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))),
                                             F.lit(float("inf"))).alias("median_time"))


def discrete_fit(df: DataFrame, time: str, event: str, features: Sequence[str], time_buckets: int = 10,
                 hidden: Sequence[int] = (32,), max_iter: int = 100, seed: int = 42) -> DiscreteModel:
    """M12 (discrete): MLP classifier on person-period rows."""
    feats = list(features)
    binned, edges = time_bins(df, time, time_buckets)
    pp = binned.withColumn("period", F.explode(F.sequence(F.lit(1), F.col("interval"))))
    pp = pp.withColumn("label", ((F.col("period") == F.col("interval")) & (F.col(event) == 1)).cast("double"))
    m = DiscreteModel(feats, time_buckets, edges)
    design = m._design(pp, F.col("period"))
    clf = MultilayerPerceptronClassifier(layers=[len(feats) + time_buckets, *hidden, 2], maxIter=max_iter,
                                         seed=seed, featuresCol="features", labelCol="label")
    m.model = clf.fit(design)
    return m
