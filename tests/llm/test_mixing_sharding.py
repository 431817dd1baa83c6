import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from eventide.llm import mixing, sharding
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            break
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    return {s: most * sizes[s] if s in full else level * weight[s] for s in names}


def check_mix(spark, df):
    rows = df.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    want = targets(sizes)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r.doc_id, r.source, size(r.text)) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3, s
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, got))
    return got


def test_mix_odd_rows_and_table(spark):
    df = odd.documents(spark)
    check_mix(spark, df)
    check_mix(spark, spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    assert mixing.mix(df.limit(0)).collect() == []
    assert mixing.mixed(df.limit(0)).collect() == []


def test_mixed_rows_hold_the_words_taken(spark):
    df = odd.clashing(odd.documents(spark).where("text is null or doc_id is not null and doc_id <> 36").drop("size"))
    got = Counter()
    out = mixing.mixed(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text) or r.text in odd.TEXTS
    assert got == Counter({r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken})


def test_a_small_source_is_clamped_and_a_cut_lands_on_repeats(spark):
    rows = [(i, "w " * 100, "big") for i in range(50)] + [(100, "x y z", "a"), (101, "x y z", "a")] + [(7, "q r s t u", "c")] * 6
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert {r.target for r in by["a"]} == {18.0} and sum(r.taken for r in by["a"]) == 18
    assert len({r.taken for r in by["c"]}) == 1 and 0 <= by["c"][0].target - sum(r.taken for r in by["c"]) < 7


def check_shards(rows, want, n=16):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert Counter(repr((r.doc_id, r["size"], r.text_crc32)) for r in rows) == want
    for s, rs in shards.items():
        assert 0 <= s < n and sorted(r.slot for r in rs) == list(range(len(rs)))
    return [sum(r["size"] for r in shards[s]) for s in range(n)]


def digests(df):
    return df.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
                     F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.xxhash64("text").alias("h"))


def wanted(df):
    return Counter(repr((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in df.collect())


def test_shards_of_the_table_are_even_and_keep_groups(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard(digests(df), group="h", tie="doc_id", size="size").collect()
    sizes = check_shards(rows, wanted(df))
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 0.06 * sum(sizes) / 16 + 2 * largest
    groups = defaultdict(set)
    for r in rows:
        groups[r.h].add(r.shard)
    assert sum(len(s) > 1 for s in groups.values()) <= 15


def test_a_huge_group_is_divided_and_runs_are_cut(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(
        F.concat(F.lit("text "), F.col("id"))).alias("text"))
    rows = sharding.shard(digests(df), group="h", tie="doc_id", size="size", rows_per_run=500).collect()
    sizes = check_shards(rows, wanted(df))
    assert max(sizes) <= 1.06 * min(sizes)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keyed = [r.h for r in order]
    assert sum(a != b for a, b in zip(keyed, keyed[1:], strict=False)) == len(set(keyed)) - 1  # equal texts are neighbours


def test_shard_odd_rows(spark):
    df = odd.documents(spark)
    extra = odd.clashing(df).drop("size").withColumn("size", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"))
    out = sharding.shard(extra.withColumn("text_crc32", F.lit(1)), group="text", tie="doc_id", size="size")
    rows = out.collect()
    assert len(rows) == df.count() and set(extra.columns) <= set(out.columns)
    assert sharding.shard(digests(df.limit(0)), group="h", tie="doc_id", size="size").collect() == []
