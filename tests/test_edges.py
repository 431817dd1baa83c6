"""Edge fixture F6: empty table, one row, all censored, all events at one time, S reaching 0,
constant risk (all concordance ties)."""

import math

import pytest

from eventide.operators import risk
from eventide.operators.concordance import concordance

SCHEMA = "t double, e int, risk double"


@pytest.mark.parametrize("rows", [
    [],
    [(5.0, 1, 0.3)],
    [(1.0, 0, 0.1), (2.0, 0, 0.2), (3.0, 0, 0.3)],
    [(4.0, 1, 0.1), (4.0, 1, 0.2), (4.0, 1, 0.3)],
    [(1.0, 0, 0.1), (2.0, 1, 0.2), (3.0, 1, 0.3)],
])
def test_km_edges(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    c = risk.kaplan_meier(df).orderBy("time").collect()
    if not rows:
        assert c == []
        return
    s = [r["survival"] for r in c]
    assert s[0] == 1.0 and all(0.0 <= x <= 1.0 for x in s)
    if all(e == 0 for _, e, _ in rows):
        assert s[-1] == 1.0
    if rows[-1][1] == 1 and max(t for t, _, _ in rows) == rows[-1][0]:
        assert s[-1] == 0.0 and c[-1]["ci_lower"] == 0.0
    med = risk.median_survival(c and risk.kaplan_meier(df)).first()["median_time"]
    assert med > 0 or math.isinf(med)


def test_constant_risk_all_ties(spark):
    df = spark.createDataFrame([(float(t), t % 2, 0.0) for t in range(1, 30)], SCHEMA)
    r = concordance(df)
    assert r["concordant"] == 0 and r["discordant"] == 0 and r["c_index"] == 0.5


def test_single_stratum_logrank(spark):
    from eventide.operators.logrank import logrank
    df = spark.createDataFrame([(float(t), 1, 0.0) for t in range(1, 10)], SCHEMA).selectExpr("*", "'a' AS g")
    assert logrank(df, "g")["statistic"] == 0.0
