import pytest

import __spark_entry__ as E
from eventide.llm.queries import ORACLE, QUERIES


def test_one_query_per_operator():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
    assert set(ORACLE) <= set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    import duckdb

    from eventide.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want))
