"""MinHash near-duplicate detection by an inverted join over signature coordinates.

1. One pass hashes every whole text's word shingles and keeps a signature of ``COORDINATES``
   minima.  Documents with equal shingle sets form a class at once; only classes go on.
2. Every class is posted under each coordinate value of its signature.  Two similar classes share
   at least M of these lists (M follows from the threshold: 10 of 24 at 85 %, 8 at 80 %; a pair at
   the threshold shares fewer with a chance below ``MISS``).  So a class needs that many lists with company (else it is
   dropped), and it need only be looked up in its rarest ones: with q such lists, in the
   q - M + 1 shortest, since two classes that share M lists share one of those (prefix);
   the others, among them the long lists of common passages, are skipped.
3. In a list the collisions over the whole signatures are counted and pairs with M or more
   joined to clusters: candidates are kept as trees, never as all pairs.  A list too
   long for one task is cut into parts, whose trees are tied together.
4. Candidates' texts are read again and links confirmed on their full shingle sets, cluster by
   cluster.  A set is compared with all others through an inverted index in memory, and only
   while it is not yet in its cluster's largest component, so a group of thousands of near copies
   takes about one comparison for each member.  Clusters too large for a task are cut into parts: each part
   is compared with the same few central members and within itself, and what is then outside the
   largest component is compared with every part, so no link between components is lost.
5. Connected components of the confirmed links give the groups.

Defined cases
* null or empty text, or no words: empty set, linked with nothing, kept;
* fewer words than a shingle: one shingle of all words; very long texts: whole, in bounded batches;
* ties: the smallest doc_id of a group names it; repeated rows share their class and their name
  and are all kept or all not; a null doc_id counts as no id: it is kept only where no id is
  reachable;
* empty table: empty result; extra columns are not read by ``near_duplicates``, kept by ``deduplicated``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm import shingles as S
from eventide.llm.common import discard, free_name, small, written
from eventide.llm.components import components

SHINGLE = 5
COORDINATES = 24
#: Chance that a pair exactly at the threshold shares too few coordinates to be a candidate.
MISS = 2e-7
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Classes of one posting list that a task compares.
LIST_PART = 2048
#: Shingles of one cluster that a task compares; clusters above are cut.
PART_SHINGLES = 500_000
#: Central members that every part of a cut cluster is compared with.
PIVOTS = 16
PIVOT_ROUNDS = 3


def _sets(docs: DataFrame, size: int, coordinates: int, with_sets: bool) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, class (128-bit hash of the set; null if empty), and its signature
    or its sorted set."""
    out = "set binary" if with_sets else "sig array<long>"

    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column("doc_id")
            for a, z, data, starts in S.text_batches(b.column("text")):
                hashes, counts = S.shingle_sets(data, starts, size)
                full = counts > 0
                begins = (np.cumsum(counts) - counts)[full]
                names = np.empty((len(begins), 2), "<u8")
                if len(begins):
                    names[:, 0] = np.add.reduceat(hashes, begins)
                    names[:, 1] = np.add.reduceat(S.mix(hashes ^ np.uint64(77)), begins) + counts[full].astype(np.uint64)
                keys = iter([names[i].tobytes() for i in range(len(begins))])
                classes = pa.array([next(keys) if f else None for f in full.tolist()], pa.binary())
                if with_sets:
                    raw, ends = hashes.astype("<u8").tobytes(), (np.cumsum(counts) * 8).tolist()
                    last = pa.array([raw[e - 8 * n:e] for e, n in zip(ends, counts.tolist(), strict=True)], pa.binary())
                else:
                    sig = S.minhash(hashes, counts, coordinates, 101).view(np.int64).ravel()
                    offsets = np.concatenate([[0], np.cumsum(np.where(full, coordinates, 0))]).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig))
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), b.column("text_hash").slice(a, z - a), pa.array(counts), classes, last],
                                                 names=["doc_id", "text_hash", "n_shingles", "class", out.split()[0]])
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id long, text_hash long, n_shingles long, class binary, {out}")


def matches_for(percent: int, coordinates: int, miss: float = MISS) -> int:
    """The largest M such that a pair at the threshold shares fewer than M coordinates with a chance
    of at most ``miss``."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def match_trees(sigs: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """Tree edges of the graph that joins rows with ``matches`` or more equal coordinates."""
    left, edges = np.arange(len(sigs)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sigs[left] == sigs[at]).sum(axis=1) >= matches
            edges += [(at, int(x)) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return edges


def _list_edges(lists: DataFrame, matches: int, coordinates: int) -> DataFrame:
    """(a, b) class pairs from rows (v, part, split, members); parts of a cut list meet at a node of its own."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            members = batch.column("members")
            offsets = members.offsets.to_numpy()
            flat = members.values
            names = flat.field("class").to_pylist()
            sigs = flat.field("sig").flatten().to_numpy().reshape(-1, coordinates)
            values, cut = batch.column("v").to_numpy(), batch.column("split").to_pylist()
            pairs = set()
            for k in range(len(values)):
                a, z = int(offsets[k]), int(offsets[k + 1])
                same = (sigs[a + 1:z] == sigs[a]).sum(axis=1) >= matches
                edges = [(0, i + 1) for i in np.flatnonzero(same).tolist()] if same.all() else match_trees(sigs[a:z], matches)
                pairs.update((names[a + x], names[a + y]) for x, y in edges)
                if cut[k]:
                    node = b"\xff" * 8 + int(values[k]).to_bytes(8, "big", signed=True)
                    linked = {y for _, y in edges}
                    pairs.update((names[a + x], node) for x in range(z - a) if x not in linked)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], names=["a", "b"])
    return lists.mapInArrow(run, "a binary, b binary")


def candidates(classes: DataFrame, *, coordinates: int, matches: int, list_part: int = LIST_PART) -> tuple[DataFrame, DataFrame]:
    """(class -> cluster of possible duplicates; class -> weight, the total length of its lists)."""
    posts = classes.select("class", F.explode("sig").alias("v"))
    lengths = posts.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = (posts.join(lengths, "v").groupBy("class")
           .agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("lists"), F.sum("n").alias("weight"))
           .where(F.size("lists") >= matches))
    own = written(own.select("class", "weight", F.slice("lists", F.lit(1), F.size("lists") - (matches - 1)).alias("lists")), "dedup-prefix")
    short = F.transform("sig", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
    posted = (own.join(classes.select("class", short.alias("sig")), "class")
              .select("class", "sig", F.explode("lists").alias("l")).select("class", "sig", "l.v", "l.n"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / list_part))
    lists = (posted.withColumn("part", F.pmod(F.xxhash64("class"), parts)).withColumn("split", parts > 1)
             .groupBy("v", "part", "split").agg(F.collect_list(F.struct("class", "sig")).alias("members"))
             .where(F.col("split") | (F.size("members") > 1)))
    edges = _list_edges(lists, matches, coordinates)
    return components(edges), own.select("class", "weight")


def link(sets: list[np.ndarray], percent: int, must: np.ndarray | None = None) -> np.ndarray:
    """Component (its first row) of every set under links of at least ``percent`` similarity.

    With ``must`` (booleans) only those rows are compared with all others; without, every row that is
    not in the largest component is, so the components are those of all links.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = list(range(m))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(m), sizes)
    posting = owner[order]
    ranked = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(flat) else np.empty(0, int)
    length = np.diff(np.append(first, len(flat)))
    shingle = np.empty(len(flat), np.int64)
    shingle[order] = np.repeat(np.arange(len(first)), length)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    count = [1] * m
    big = 0

    def compare(i):
        nonlocal big
        own = shingle[starts[i]:starts[i + 1]]
        own = own[length[own] > 1]
        if not len(own):
            return
        n = length[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(posting[at], minlength=m)
        for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)).tolist():
            a, b = find(i), find(j)
            if a != b:
                a, b = min(a, b), max(a, b)
                root[b] = a
                count[a] += count[b]
                if count[a] > count[find(big)]:
                    big = a
    if must is not None:
        for i in np.flatnonzero(must).tolist():
            compare(i)
    else:
        shared = np.add.reduceat(length[shingle], starts[:-1]) / sizes if m else []
        waiting = np.argsort(-np.asarray(shared), kind="stable").tolist()  # the most central row first
        while True:
            later = []
            for i in waiting:
                if count[find(big)] > 1 and find(i) == find(big):
                    later.append(i)
                else:
                    compare(i)
            if all(find(i) == find(big) for i in later):
                break
            waiting = later
    return np.array([find(i) for i in range(m)])


def _confirm(rows: DataFrame, keys: list[str], percent: int, only_marked: bool) -> DataFrame:
    """Confirmed links as tree edges (a, b); rows: keys, cluster, class, set, marked."""
    def run(table):
        import pyarrow as pa
        table = table.sort_by([("cluster", "ascending"), ("class", "ascending")])
        clusters, names = table.column("cluster").to_pylist(), table.column("class").to_pylist()
        raw, marked = table.column("set").to_pylist(), table.column("marked").to_pylist()
        pairs, a = [], 0
        while a < len(names):
            z = a
            rows_, flags = [], {}
            while z < len(names) and clusters[z] == clusters[a]:
                if names[z] not in flags:
                    rows_.append(z)
                flags[names[z]] = flags.get(names[z], False) or marked[z]
                z += 1
            must = np.array([flags[names[r]] for r in rows_]) if only_marked else None
            found = link([np.frombuffer(raw[r], "<u8") for r in rows_], percent, must)
            pairs += [(names[rows_[i]], names[rows_[r]]) for i, r in enumerate(found.tolist()) if i != r]
            a = z
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})
    return rows.groupBy(*keys).applyInArrow(run, "a binary, b binary")


def confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, weights: DataFrame, *, size: int, coordinates: int,
              percent: int, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Tree edges (a, b) of the links between classes, confirmed on full sets."""
    members = written(classes.select("class", "doc", F.col("n_shingles").alias("n"))
                      .join(clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")), "class")
                      .join(weights, "class"), "dedup-members")
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1")
    parts = F.ceil(F.col("total") / part_shingles).cast("int")
    sizes = written(sizes.select("cluster", "total", parts.alias("parts")), "dedup-sizes")
    stats = sizes.agg(F.count(F.lit(1)), F.sum(F.when(F.col("parts") == 1, F.col("total"))), F.max("parts")).first()
    members = members.join(small(sizes, stats[0]), "cluster")

    def with_sets(chosen):
        """Read the texts of the chosen classes again (one document each) and attach their sets."""
        chosen = chosen.select("class", "doc", "cluster", "parts")
        n = chosen.count()
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
            .join(small(chosen.select(F.col("doc").alias("d")).distinct(), n), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        sets = _sets(texts, size, coordinates, True).where(F.col("class").isNotNull()).select("class", "set")
        return sets.join(small(chosen.select("class", "cluster", "parts"), n), "class")

    none = F.lit(False).alias("marked")
    buckets = max(1, (stats[1] or 0) // (4 * part_shingles))
    cold = with_sets(members.where("parts = 1")).select(F.pmod(F.xxhash64("cluster"), F.lit(buckets)).alias("bucket"),
                                                        "cluster", "class", "set", none)
    edges = written(_confirm(cold, ["bucket"], percent, False), "dedup-links")
    if (stats[2] or 0) <= 1:
        return edges
    # clusters of several parts
    hot = members.where("parts > 1")
    hot_sets = written(with_sets(hot).dropDuplicates(["class"])
                       .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")), "dedup-hot")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    outside = hot.select("class", "cluster", "weight")
    for step in range(PIVOT_ROUNDS):
        best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "class"))
        pivots = written(outside.withColumn("r", best).where(F.col("r") <= PIVOTS).select("class"), "dedup-pivots")
        marked = hot_sets.join(F.broadcast(pivots), "class").select("cluster", "class", "set", F.lit(True).alias("marked"), every.alias("part"))
        rows = hot_sets.select("cluster", "class", "set", none, "part").unionByName(marked)
        more = written(_confirm(rows, ["cluster", "part"], percent, step > 0), "dedup-links")
        edges = edges.union(more)
        outside = _outside(hot, edges)
        if outside.isEmpty():
            return edges
    # the rest against every part, in chunks of bounded size
    rest = outside.join(hot.select("class", "n"), "class")
    share = F.ceil(F.col("total") / part_shingles).cast("int")
    chunks = written(rest.groupBy("cluster").agg(F.sum("n").alias("total")).select("cluster", share.alias("chunks")), "dedup-chunks")
    rest = (hot_sets.join(rest.select("class"), "class").join(chunks, "cluster")
            .select("cluster", "class", "set", F.lit(True).alias("marked"), F.pmod(F.xxhash64("class", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
                    every.alias("part")))
    whole = hot_sets.join(chunks, "cluster").select("cluster", "class", "set", none, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part")
    return edges.union(written(_confirm(whole.unionByName(rest), ["cluster", "part", "chunk"], percent, True), "dedup-links"))


def _outside(hot: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of cut clusters that are not in their cluster's largest component so far."""
    roots = components(edges)
    named = hot.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    largest = (named.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k"))
               .groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("largest")))
    return written(named.join(largest, "cluster").where(F.col("root") != F.col("largest")).select("class", "cluster", "weight"), "dedup-outside")


def _labelled(docs: DataFrame, *, size: int = SHINGLE, coordinates: int = COORDINATES, matches: int | None = None, percent: int = PERCENT,
              part_shingles: int = PART_SHINGLES, list_part: int = LIST_PART) -> DataFrame:
    matches = matches or matches_for(percent, coordinates)
    rows = written(_sets(docs, size, coordinates, False), "dedup-rows")
    classes = written(rows.where(F.col("class").isNotNull()).groupBy("class")
                      .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("copies"),
                           F.first("sig").alias("sig")), "dedup-classes")
    clusters, weights = candidates(classes, coordinates=coordinates, matches=matches, list_part=list_part)
    links = confirmed(docs, classes, clusters, weights, size=size, coordinates=coordinates, percent=percent, part_shingles=part_shingles)
    roots = components(links)
    discard(clusters)
    narrow = classes.select("class", "doc", "copies")
    linked = narrow.join(roots.withColumnRenamed("node", "class"), "class")
    names = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = (linked.join(names, "root").select("class", "component_id")
              .union(narrow.where("copies > 1").join(roots.select(F.col("node").alias("class")), "class", "left_anti")
                     .select("class", F.col("doc").alias("component_id"))))
    labels = written(labels, "dedup-labels").withColumn("named", F.lit(True))
    out = rows.join(small(labels, labels.count()), "class", "left")
    return out.select("doc_id", "text_hash", "n_shingles",
                      F.when(F.coalesce("named", F.lit(False)), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    return _labelled(docs, **options).select("doc_id", "n_shingles", "component_id",
                                             F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the rows of ``docs`` with the group's smallest doc_id, each once
    if repeated; columns stay.  The table of dropped ids is broadcast only if it is small."""
    found = _labelled(docs, **options)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    hashed, d, h = (free_name(docs, f"dedup_{n}") for n in ("hash", "doc", "text"))
    key = [F.col("doc_id").alias(d), F.col("text_hash").alias(h)]
    dropped = written(found.where(~kept).select(*key).distinct(), "dedup-dropped")
    twice = written(found.where(kept).groupBy(*key).count().where("count > 1").select(d, h), "dedup-twice")
    n_twice = twice.count()
    named = docs.withColumn(hashed, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(hashed).eqNullSafe(F.col(h)))
    out = named.join(small(dropped, dropped.count()), same, "left_anti")
    if n_twice:
        again = out.join(small(twice, n_twice), same, "left_semi")
        out = out.join(small(twice, n_twice), same, "left_anti").unionByName(again.dropDuplicates(["doc_id", "text"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
