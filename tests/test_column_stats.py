"""Distinct counts and medians of column_stats from one pass of value counts."""
import datetime as dt
import decimal

from eventide.operators.profile import column_stats


def test_distinct_and_medians_of_odd_values(spark):
    big = 2 ** 53
    rows = [(big, 0.0, "a", decimal.Decimal("1.10"), dt.date(2024, 1, 1), b"x", [1, 2], True, None),
            (big + 1, -0.0, "a", decimal.Decimal("1.10"), dt.date(2024, 1, 2), b"y", [1, 2], False, None),
            (None, float("nan"), "", None, None, None, None, None, None),
            (3, 5.0, None, decimal.Decimal("2.00"), dt.date(2024, 1, 1), b"x", [12], True, None)]
    df = spark.createDataFrame(rows, "l long, d double, s string, m decimal(10,2), t date, b binary, a array<int>, f boolean, z int")
    got = {r["column_name"]: r for r in column_stats(df).collect()}
    assert {c: r["n_distinct"] for c, r in got.items()} == {"l": 3, "d": 3, "s": 2, "m": 2, "t": 2, "b": 2, "a": 2, "f": 2, "z": 0}
    assert {c: r["missing"] for c, r in got.items()} == {"l": 1, "d": 0, "s": 1, "m": 1, "t": 1, "b": 1, "a": 1, "f": 1, "z": 4}
    assert got["l"]["median"] == float(big) and got["d"]["median"] == 2.5 and got["z"]["median"] is None and got["s"]["median"] is None
    empty = {r["column_name"]: (r["n_distinct"], r["median"]) for r in column_stats(df.limit(0)).collect()}
    assert set(empty.values()) == {(0, None)}
