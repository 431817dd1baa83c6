"""Hard-negative mining with R-trees packed by sort-tile-recursive order.

Integer vectors are range-sorted by label and their leading coordinates into blocks, and each
block's rows are packed once: sorted by a coordinate, cut into slabs, each slab sorted by the next
coordinate and cut again, until ``LEAF`` rows remain.  A leaf holds rows of one label.  The packed rows
(block, leaf) are stored; a search task rebuilds only the minimum bounding boxes, leaves first, then
``FANOUT`` boxes at a time up to the root.

An anchor's inner product with any row of a box lies in the sum over coordinates of the interval that
the box's side gives.  A queue opens boxes best-first by the upper end, a few at a time; a box is
dropped when its interval lies outside of every score window asked for, or strictly below the k-th
score found so far in each window that it could serve.  Leaves are scored exactly.

Two searches: the best rows of the anchor's label (its positives), then, for all of an anchor's
positives in one traversal, the best rows of other labels whose score lies between a lower and an upper
share of the positive's.  Anchors meet blocks in chunks: each block's rows are sent once for
``CHUNK`` anchors; blocks answer on their own and a window over their answers keeps each best few.

Defined cases
* rows with a null label, a null vector, no components, or a null or non-finite component take no part;
* vectors of different length are never compared;
* ties go to the smaller vec_id (null vec_id last); rows that repeat an anchor's vec_id are not its
  partners; anchor rows that repeat in full are asked once, others that repeat are rows of their own;
* one label or one vector may fill any share of the rows: blocks are cut by (label, coordinates,
  vec_id, row number);
* an anchor without positives, or without rows in a window, returns nothing for it;
* scores beyond the range of a long saturate; empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm import topk
from eventide.llm.common import written

SCALE = 256
LEAF = 128
FANOUT = 8
#: Leaves that are opened together.
BITE = 8
BLOCK_ROWS = 32_768
CHUNK = 8192
_NO_ID = np.iinfo(np.int64).max


def quantised(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, q): components floor(scale * x) of the rows that take part."""
    v = F.col(vec_col)
    usable = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                                     F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("q"))


def str_order(values: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order in which every ``leaf`` rows are one tile of a sort-tile-recursive packing."""
    rows, dims = values.shape
    by_spread = np.argsort(-values.astype(float).var(axis=0), kind="stable") if rows else np.arange(dims)

    def tile(part: np.ndarray, level: int) -> list[np.ndarray]:
        leaves = -(-len(part) // leaf)
        if leaves <= 1 or level >= dims:
            return [part]
        part = part[np.argsort(values[part, by_spread[level]], kind="stable")]
        # as many slabs as leave the same number of cuts for each coordinate still to come, two at least
        slabs = max(2, int(np.ceil(leaves ** (1 / min(dims - level, 1 + int(np.log2(leaves)))))))
        rows_each = leaf * -(-leaves // slabs)
        return [x for a in range(0, len(part), rows_each) for x in tile(part[a:a + rows_each], level + 1)]
    return np.concatenate(tile(np.arange(rows), 0)) if rows else np.arange(0)


class RTree:
    """Boxes over rows that stand in packed order; ``leaf_of`` numbers each row's leaf, ascending."""

    def __init__(self, values: np.ndarray, labels: np.ndarray, leaf_of: np.ndarray):
        self.values, self.labels = values, labels
        starts = np.flatnonzero(np.concatenate([[True], leaf_of[1:] != leaf_of[:-1]]))
        self.begin, self.end = starts, np.append(starts[1:], len(leaf_of))
        self.largest = float(np.abs(values.astype(float)).max(initial=0))
        box = (np.minimum.reduceat(values, starts).astype(float), np.maximum.reduceat(values, starts).astype(float),
               np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts))
        self.levels = [box]  # leaves first
        while len(self.levels[-1][0]) > 1:
            low, high, first, last = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
        self.floats = values.astype(float)

    def intervals(self, queries: np.ndarray):
        """By level: lower and upper bounds (queries x boxes) of the inner products with any row of a box."""
        q = queries.astype(float)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # sums of doubles are exact below 2**53; beyond, the bounds give way by more than the rounding
        reach = self.largest * np.abs(q).sum(axis=1)
        slack = np.where(reach < 2.0**52, 0.0, reach * 1e-12)[:, None]
        largest = np.nextafter(2.0**63, 0)  # scores saturate to a long, and so do their bounds
        return [(np.minimum(up @ low.T + down @ high.T - slack, largest), np.maximum(up @ high.T + down @ low.T + slack, -2.0**63))
                for low, high, _, _ in self.levels]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(query.astype(float)).sum()) < 2.0**52:
            return (self.floats[rows] @ query.astype(float)).astype(np.int64)
        return np.clip(topk.exact(self.values[rows], query, self.largest), -2**63, 2**63 - 1).astype(np.int64)

    def search(self, query: np.ndarray, bounds, own: int, ids: np.ndarray, label: int, same: bool, k: int,
               windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each score window (least, most): (ids, scores) of its k best rows of the anchor's label, or of other labels."""
        found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
        floors = [w[0] for w in windows]  # what a row must reach to matter

        def wanted(level: int, box: int) -> bool:
            _, _, first, last = self.levels[level]
            if not (first[box] <= label <= last[box] if same else first[box] != label or last[box] != label):
                return False
            low, high = bounds[level][0][box], bounds[level][1][box]
            return any(high >= f and low <= w[1] for f, w in zip(floors, windows, strict=True))

        top = len(self.levels) - 1
        queue = [(-bounds[top][1][0], top, 0)] if wanted(top, 0) else []
        while queue:
            bite = []
            while queue and len(bite) < BITE:
                _, level, box = heapq.heappop(queue)
                if not wanted(level, box):  # the floors have risen since
                    continue
                if not level:
                    bite.append(box)
                    continue
                upper = bounds[level - 1][1]
                for child in range(box * FANOUT, min((box + 1) * FANOUT, len(self.levels[level - 1][0]))):
                    if wanted(level - 1, child):
                        heapq.heappush(queue, (-upper[child], level - 1, child))
            if not bite:
                continue
            rows = np.concatenate([np.arange(self.begin[x], self.end[x]) for x in bite])
            score = self.scores(rows, query)
            fits = (score >= min(floors)) & ((self.labels[rows] == label) == same) & (ids[rows] != own)
            rows, score = rows[fits], score[fits]
            if not len(rows):
                continue
            for j, (_, most) in enumerate(windows):
                mine = (score >= floors[j]) & (score <= most)
                if mine.any():
                    got_ids, got = np.append(found[j][0], ids[rows[mine]]), np.append(found[j][1], score[mine])
                    best = np.lexsort((got_ids, -got))[:k]
                    found[j] = got_ids[best], got[best]
                    if len(best) == k:
                        floors[j] = max(floors[j], int(got[best[-1]]))
        return found


def pack(rows: DataFrame, *, block_rows: int = BLOCK_ROWS, leaf: int = LEAF) -> DataFrame:
    """(block, leaf, dims, id, label, q): all rows in packed order, written once."""
    # a row number, fixed by writing, cuts runs of equal rows
    rows = written(rows.select("id", "label", "q", F.size("q").alias("dims"), F.monotonically_increasing_id().alias("row")), "negatives-rows")
    n_blocks = max(1, -(-rows.count() // block_rows))
    second = F.coalesce(F.try_element_at("q", F.lit(2)), F.lit(0))
    dealt = rows.repartitionByRange(n_blocks, "dims", "label", F.element_at("q", 1), second, "id", "row").withColumn("block", F.spark_partition_id())

    def packed(batches):
        import pyarrow as pa
        tables = list(batches)  # one block
        if not tables:
            return
        t = pa.Table.from_batches(tables).combine_chunks()
        dims, labels = t.column("dims").to_numpy(), t.column("label").to_numpy()
        first = 0
        for d in np.unique(dims):
            for x in np.unique(labels[dims == d]):
                at = np.flatnonzero((dims == d) & (labels == x))
                part = t.take(pa.array(at))
                values = part.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                order = str_order(values, leaf)
                part = part.take(pa.array(order))
                leaves = first + np.arange(len(at)) // leaf
                first = int(leaves[-1]) + 1
                part = part.append_column("leaf", pa.array(leaves.astype(np.int32)))
                yield from part.select(["block", "leaf", "dims", "id", "label", "q"]).to_batches(max_chunksize=4096)
    return written(dealt.mapInArrow(packed, "block int, leaf int, dims int, id long, label long, q array<bigint>"), "negatives-packed")


def _matrix(table, dims: int):
    n = table.num_rows
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = table.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
    return ids, table.column("label").to_numpy(), flat.reshape(n, dims)


def _searched(packed: DataFrame, asked: DataFrame, k: int, same: bool, chunk: int) -> DataFrame:
    """(query, anchor_id, asked_id, asked_score, vec_id, score): each block's k best rows for each window of each anchor.

    ``asked``: (id, label, q, query, windows array<struct<id, score, least, most>>).
    """
    n_blocks = (packed.agg(F.max("block")).first()[0] or 0) + 1
    n_chunks = max(1, -(-asked.count() // chunk))
    rows = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    asked = (asked.withColumn("dims", F.size("q")).withColumn("chunk", F.pmod(F.xxhash64("query", F.lit(7)), F.lit(n_chunks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))

    def answer(key, left, right):
        import pyarrow as pa
        names = ["query", "anchor_id", "asked_id", "asked_score", "vec_id", "score"]
        out = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            dims = key[2].as_py()
            left = left.sort_by("leaf")
            ids, labels, values = _matrix(left, dims)
            tree = RTree(values, labels, left.column("leaf").to_numpy())
            anchors, own_labels, queries = _matrix(right, dims)
            names_of, windows = right.column("query").to_pylist(), right.column("windows").to_pylist()
            for a in range(0, len(anchors), 64):
                levels = tree.intervals(queries[a:a + 64])
                for i in range(a, min(a + 64, len(anchors))):
                    bounds = [(low[i - a], high[i - a]) for low, high in levels]
                    found = tree.search(queries[i], bounds, anchors[i], ids, own_labels[i], same, k, [(w["least"], w["most"]) for w in windows[i]])
                    for w, (got, score) in zip(windows[i], found, strict=True):
                        out["query"] += [names_of[i]] * len(got)
                        out["anchor_id"] += [int(anchors[i])] * len(got)
                        out["asked_id"] += [w["id"]] * len(got)
                        out["asked_score"] += [w["score"]] * len(got)
                        out["vec_id"] += got.tolist()
                        out["score"] += score.tolist()
        return pa.table({c: pa.array([None if v == _NO_ID and c.endswith("_id") else v for v in out[c]], pa.int64()) for c in names})

    keys = ["block", "chunk", "dims"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        answer, "query long, anchor_id long, asked_id long, asked_score long, vec_id long, score long")


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95,
         block_rows: int = BLOCK_ROWS, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels that score from ``lower``
    to ``upper`` percent of the positive.  Both tables are (id, label, q)."""
    packed = pack(rows, block_rows=block_rows, leaf=leaf)
    window = "array<struct<id: bigint, score: bigint, least: bigint, most: bigint>>"
    every = F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("score"),
                             F.lit(-2**63).cast("long").alias("least"), F.lit(2**63 - 1).cast("long").alias("most"))).cast(window)
    asked = written(anchors.select("id", "label", "q").distinct().withColumn("query", F.xxhash64("id", "label", "q")), "negatives-anchors")
    order = [F.desc("score"), F.col("vec_id").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("anchor_id", "query").orderBy(*order))
    best = (_searched(packed, asked.withColumn("windows", every), positives, True, chunk)
            .withColumn("rank", rank).where(F.col("rank") <= positives))
    # least = ceil(lower * score / 100), most = floor(upper * score / 100), in decimals; div cuts toward zero
    share = lambda p, up: F.expr(f"cast(floor((cast(score as decimal(20,0)) * {p} + {up}) / 100) as bigint)")
    windows = (best.withColumn("least", share(lower, 99)).withColumn("most", share(upper, 0)).where(F.col("least") <= F.col("most"))
               .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score", "least", "most"))).alias("w"))
               .select("query", F.expr("transform(w, x -> struct(x.id, x.score, x.least, x.most))").cast(window).alias("windows")))
    windows = written(asked.join(windows, "query"), "negatives-windows")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "query", "asked_id", "asked_score").orderBy(*order))
    return (_searched(packed, windows, negatives, False, chunk)
            .withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", F.col("asked_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("vec_id").alias("negative_id"), F.col("asked_score").alias("positive_score"), F.col("score").alias("negative_score")))
