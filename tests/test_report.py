"""Report and chart tables: thresholds, bins, transition probabilities, views."""

import pytest
from pyspark.sql import functions as F

from eventide.operators import report as T
from eventide.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_risk_groups_score_mode(spark):
    df = spark.createDataFrame([(float(i) / 10,) for i in range(11)], "risk double")
    g = {r["risk_group"]: r["count"] for r in T.risk_groups(df, "risk", (0.25, 0.75), "score").collect()}
    assert g == {"low": 3, "medium": 5, "high": 3}


def test_heatmap_quantile_bins_are_balanced(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                  (F.col("id") % 2).cast("double").alias("r"))
    h = T.risk_heatmap(df, "a", "b", "r", bins=4, binning="quantile")
    per_x = {r["bin_x"]: r["n"] for r in h.groupBy("bin_x").agg(F.sum("n").alias("n")).collect()}
    assert sorted(per_x) == [0, 1, 2, 3] and max(per_x.values()) - min(per_x.values()) <= 4


def test_transition_probabilities_sum_to_one(spark):
    t = T.transition_counts(fx.journey(spark, SF_SMALL))
    sums = t.groupBy("from_state").agg(F.sum("probability").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-12 for r in sums)


def test_trend_table_horizon_cap(spark):
    with pytest.raises(ValueError):
        T.trend_table(fx.reorder(spark, SF_SMALL), [float(i) for i in range(37)])


def test_time_dependent_view_joins_on_time(spark):
    b = spark.createDataFrame([(1.0, 0.1), (2.0, 0.2)], "time double, brier double")
    a = spark.createDataFrame([(2.0, 0.7), (3.0, 0.6)], "time double, auc double")
    rows = [(r["time"], r["brier"], r["auc"]) for r in T.time_dependent_view(b, a).collect()]
    assert rows == [(1.0, 0.1, None), (2.0, 0.2, 0.7), (3.0, None, 0.6)]
