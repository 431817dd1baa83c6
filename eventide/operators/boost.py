"""Gradient-boosted Cox model (M10) with split-gain importance.

Each round: the Breslow time table at the current scores gives the negative
gradient of the Cox loss per row (martingale residual E - e^f A(T)); a Spark
ML regression tree is fitted to it on a hash subsample and added with the
learning rate.  Scores are checkpointed every few rounds so the lineage
stays short.  The three back ends of the original (three different boosting
libraries) collapse into this one Spark-native learner.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.exprs import hash_unit
from eventide.plans.scan import SINGLE_WINDOW_MAX_ROWS, cumulative, right_size
from eventide.session import cut_lineage

BROADCAST_TIMES = 1_000_000


def _breslow_A(cur: DataFrame, two_level: bool, score: str = "f") -> DataFrame:
    tt = cur.groupBy(F.col("t").alias("time")).agg(F.sum(F.col("e").cast("double")).alias("d"),
                                                   F.sum(F.exp(score)).alias("S0p"))
    tt = cumulative(tt, "time", [], sums={"S0": "S0p"}, descending=True, force_two_level=two_level)
    tt = cumulative(tt.withColumn("dh", F.col("d") / F.col("S0")), "time", [], sums={"A": "dh"}, force_two_level=two_level)
    return tt.select("time", "A")


@dataclass
class BoostModel:
    features: list[str]
    learning_rate: float
    trees: list = field(default_factory=list)
    baseline: DataFrame = field(repr=False, default=None)
    importances: np.ndarray | None = None

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        x = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep") \
            .transform(df.select(*keep, *self.features)).withColumn("f", F.lit(0.0))
        for tr in self.trees:
            tr = tr.copy().setFeaturesCol("_features").setPredictionCol("_p")
            x = tr.transform(x).withColumn("f", F.col("f") + self.learning_rate * F.col("_p")).drop("_p")
        return x.drop("_features").withColumn("risk", F.exp("f"))

    def predict_survival(self, df: DataFrame, times: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
        aggs = [F.max(F.when(F.col("time") <= float(t), F.col("baseline_hazard"))).alias(f"h{i}")
                for i, t in enumerate(times)]
        row = self.baseline.agg(*aggs).first()
        grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("time"), F.lit(float(row[f"h{i}"] or 0.0))
                                            .alias("h0")) for i, t in enumerate(times)])).alias("g")
        r = self.score(df, keep).select(*keep, "risk", grid)
        return r.select(*keep, F.col("g.time").alias("time"), F.exp(-F.col("g.h0") * F.col("risk")).alias("survival"))

    def importance(self, spark) -> DataFrame:
        """Mean split-gain importance over trees."""
        imp = self.importances if self.importances is not None else np.zeros(len(self.features))
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.features, imp)],
                                     "feature string, importance double")


def boost_fit(df: DataFrame, time: str, event: str, features: Sequence[str], id_col: str,
              n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
              subsample: float = 1.0, seed: int = 42, checkpoint_every: int = 10) -> BoostModel:
    feats = list(features)
    base = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(
        df.select(F.col(id_col).alias("_id"), F.col(time).cast("double").alias("t"),
                  F.col(event).cast("int").alias("e"), *[F.col(f).cast("double").alias(f) for f in feats]))
    cur = base.select("_id", "t", "e", "features").withColumn("f", F.lit(0.0))
    cur = cut_lineage(right_size(cur))
    n_times = cur.select("t").distinct().count()
    model = BoostModel(feats, learning_rate)
    imp = np.zeros(len(feats))
    for m in range(n_estimators):
        A = _breslow_A(cur, n_times > SINGLE_WINDOW_MAX_ROWS)
        A = F.broadcast(A) if n_times <= BROADCAST_TIMES else A
        res = cur.join(A, cur["t"] == A["time"], "inner").withColumn(
            "r", F.col("e") - F.exp("f") * F.col("A")).drop("time", "A")
        train = res if subsample >= 1.0 else res.where(hash_unit(f"{seed}:{m}", F.col("_id")) < subsample)
        tree = DecisionTreeRegressor(featuresCol="features", labelCol="r", maxDepth=max_depth,
                                     seed=seed + m).fit(train)
        model.trees.append(tree)
        imp += tree.featureImportances.toArray()
        nxt = tree.setPredictionCol("_p").transform(cur).withColumn(
            "f", F.col("f") + learning_rate * F.col("_p")).drop("_p")
        if (m + 1) % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        else:
            nxt = nxt.persist(StorageLevel.MEMORY_AND_DISK)
        cur.unpersist()
        cur = nxt
    model.importances = imp / max(n_estimators, 1)
    A = _breslow_A(cur, n_times > SINGLE_WINDOW_MAX_ROWS)
    model.baseline = A.select("time", F.col("A").alias("baseline_hazard")).persist(StorageLevel.MEMORY_AND_DISK)
    return model
