import random
import re

import numpy as np
import pytest

from eventide.llm import near_dedup, shingles
from eventide.llm.components import components
from tests.llm import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and sets[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            names[r] = min(names.get(r, d), d)
    return sorted((repr(d), len(s), names.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df, **options):
    rows = near_dedup.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in rows)


def near_copies(n, seed, words=120):
    """Texts edited a little or a lot from a few bases, shared passages, and pairs about the threshold."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    bases = [[f"w{b}_{rng.randrange(5000)}" for _ in range(words)] for b in range(4)]
    out = []
    for i in range(n):
        text = list(bases[min(3, rng.randrange(12))])
        if rng.random() < 0.3:
            text = [f"u{i}_{k}" for k in range(words)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 9])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        if rng.random() < 0.2:
            text[10:10] = passage
        out.append((i + 1, " ".join(text)))
    return out


@pytest.mark.parametrize("options", [{}, {"part_shingles": 3000, "list_part": 16}])
def test_equals_brute_force(spark, options):
    rows = near_copies(260, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, **options) == brute_force(rows)


def test_odd_rows(spark):
    df = odd.documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(odd.clashing(df)) == brute_force(rows)
    assert found(df.limit(0)) == []
    kept = near_dedup.deduplicated(odd.clashing(df))
    assert kept.columns == odd.clashing(df).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    want = sorted({d for d, _ in rows if d is not None} & {c for _, _, c in brute_force(rows)})
    assert ids == want


def test_whole_table(spark):
    from eventide.llm.queries import QUERIES
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in QUERIES["op4_near_dedup"](spark, "/root/testdata/sf0.01").collect())
    assert got == brute_force(rows)


def test_sets_have_the_right_sizes():
    import pyarrow as pa
    texts = [t for t in odd.TEXTS]
    for a, z, data, starts in shingles.text_batches(pa.array(texts), 5000):
        _, counts = shingles.shingle_sets(data, starts, 5)
        assert counts.tolist() == [len(shingle_set(t)) for t in texts[a:z]]


def test_link_needs_every_pair_only_where_it_matters():
    rng = np.random.default_rng(5)
    for trial in range(30):
        pool = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
        sets = [np.sort(rng.choice(pool, rng.integers(30, 60), replace=False)) for _ in range(40)]
        got = near_dedup.link(sets, 60 + trial)
        root = list(range(40))
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= (60 + trial) * (len(sets[i]) + len(sets[j]) - both):
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert {tuple(np.flatnonzero(got == g)) for g in got} == {tuple(k for k in range(40) if root[k] == r) for r in root}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_matches_follow_the_threshold():
    assert [near_dedup.matches_for(p, 24) for p in (85, 80, 100, 1)] == [10, 8, 24, 1]
