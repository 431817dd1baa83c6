"""Counts of collocations travel packed: a row for each range of hashes, not one a phrase."""

import numpy as np

from eventide.llm import collocations as C


def test_bodies_keep_codes_and_numbers():
    rng = np.random.default_rng(0)
    code = np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2)) >> np.uint64(16) << np.uint64(16)
    n, need = rng.integers(1, 2**32, 500), rng.integers(1, 40, 500)
    (batch,) = C._bodies(code, n, need, 7)
    assert batch.column("bucket").to_pylist() == list(range(7))
    got = C._read_bodies(batch.column("body").to_pylist())
    assert (got[0] << np.uint64(16) == code).all() and (got[1] == n).all() and (got[2] == need).all()


def test_a_task_sends_a_row_a_range(spark, monkeypatch):
    """Mined and counted phrases were a shuffled row each, added up by hash aggregates."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(" ".join(words), "en"), (" ".join(words), "de"), (" ".join(words[:90]), None)] * 2, "text string, lang string").coalesce(2)
    seen = []
    monkeypatch.setattr(C, "written", lambda df, name, real=C.written: seen.append((name, df)) or real(df, name))
    found, _ = C.frequent(docs, support=2, shards=2, longest=2)
    got = {(r["lang"], r["phrase"], r["k"]): r["f"] for r in found.collect()}
    assert len(got) == 2 * (300 + 299) + 90 + 89 and set(got.values()) == {2}
    for name, df in seen:
        if name in ("phrase-union", "phrase-counts"):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan and "RepartitionByExpression [bucket" in plan
    assert {n for n, _ in seen} >= {"phrase-union", "phrase-counts"}
