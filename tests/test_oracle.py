"""Every registered query with an oracle agrees with DuckDB on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from eventide.sources.tables import TABLES
from tests.conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, 5)
        return 0.0 if r == 0 else r
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = sorted(repr(tuple(_norm(x) for x in r)) for r in sdf.collect())
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    order = [dcols.index(c) for c in scols]
    drows = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in res.fetchall())
    assert len(srows) == len(drows)
    assert srows == drows


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "survival" in df.columns
