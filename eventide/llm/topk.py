"""Exact top-k inner-product search with a bit-sliced index.

Vectors are quantised to integers and dealt into blocks.  A block's index holds, for every
dimension, the top ``SLICES`` bits of each vector's component (less the block's minimum) as
bitmaps over the block's rows.  A query adds those slices with bitmap arithmetic: a component of
the query is written in signed digits, every digit adds the dimension's slices (complemented for a
negative digit) at its power of two, and carry-save adders turn the pile of bitmaps into one
bit-sliced sum per row.  The sum bounds every row's score from below and, with the dropped low
bits, from above.  The k-th largest lower bound is found from the most significant slice downward;
rows whose upper bound does not reach it are out, and the boundary rows that remain are scored
exactly from the stored components.  Blocks answer on their own; a window over the blocks' answers
keeps the best k of each query.

Queries meet every block, so the work is (queries / ``QUERY_CHUNK``) x blocks tasks of bounded size.

Defined cases
* null vectors, or vectors that hold a null or non-finite component, or without components, take
  no part; vectors of different length are never compared;
* ties go to the smaller vec_id (null vec_id last); repeated rows are rows of their own, a query
  row leaves out itself and rows that repeat its vec_id; query rows that repeat in full are asked once;
* scores beyond the range of a long saturate; empty table: empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import written

SCALE = 64
BLOCK_ROWS = 32_768
QUERY_CHUNK = 1024
#: Bits of a component that are kept as bitmaps.
SLICES = 6


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, q): components floor(scale * x) of the vectors that take part."""
    v = F.col(vec_col)
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(usable)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("q")))


class BlockIndex:
    """Bit slices of one block of integer vectors (rows x dimensions)."""

    def __init__(self, values: np.ndarray, slices: int = SLICES):
        self.largest = float(np.abs(values.astype(np.float64)).max(initial=0))
        self.values = values.astype(np.int16) if self.largest < 2**15 else values
        self.rows, self.dims = values.shape
        above = values.view(np.uint64) - values.min(axis=0).view(np.uint64)  # exact also where int64 would overflow
        span = int(above.max())
        self.drop = max(0, span.bit_length() - slices)
        self.bits = max(1, min(slices, span.bit_length()))
        coarse = above >> np.uint64(self.drop)
        words = -(-self.rows // 64)
        self.maps = np.zeros((2, self.dims, self.bits, words), np.uint64)
        for b in range(self.bits):
            on = ((coarse >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            packed = np.packbits(on, axis=0, bitorder="little").T  # dims x bytes
            room = np.zeros((self.dims, words * 8), np.uint8)
            room[:, :packed.shape[1]] = packed
            self.maps[0, :, b] = room.view(np.uint64)
        self.maps[1] = ~self.maps[0]
        self.live = np.zeros(words * 8, np.uint8)
        full = np.packbits(np.ones(self.rows, np.uint8), bitorder="little")
        self.live[:len(full)] = full
        self.live = self.live.view(np.uint64)

    @staticmethod
    def digits(x: int):
        """(power, negative) of the non-adjacent signed binary digits of ``x``."""
        p = 0
        while x:
            if x & 1:
                d = 2 - (x & 3)
                yield p, d < 0
                x -= d
            x >>= 1
            p += 1

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit-sliced sums (least significant first) that rank rows by their coarse score."""
        piles: dict[int, list[np.ndarray]] = {}
        for d, x in enumerate(query.tolist()):
            for p, negative in self.digits(x):
                maps = self.maps[int(negative), d]
                for b in range(self.bits):
                    piles.setdefault(p + b, []).append(maps[b])
        out, p = [], 0
        while piles:
            pile = piles.pop(p, [])
            carry = piles.setdefault(p + 1, []) if len(pile) > 1 else None
            k = 0
            while len(pile) - k > 2:  # three bitmaps of one weight: a sum and a carry
                a, b, c = pile[k], pile[k + 1], pile[k + 2]
                k += 3
                ab = a ^ b
                pile.append(ab ^ c)
                ab &= c
                ab |= a & b
                carry.append(ab)
            if len(pile) - k == 2:
                a, b = pile[k], pile[k + 1]
                carry.append(a & b)
                pile.append(a ^ b)
                k += 2
            out.append(pile[k] if pile else np.zeros_like(self.live))
            p += 1
        return out

    def search(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that hold every one of the block's k best scores (and few others)."""
        slices = self.sums(query)
        # rows with the largest coarse sums: fix the sum's bits from the most significant downward
        sure, open_, bound = np.zeros_like(self.live), self.live, 0
        need = k
        for b in range(len(slices) - 1, -1, -1):
            high = open_ & slices[b]
            n = int(np.bitwise_count(high).sum())
            if n >= need:
                open_, bound = high, bound | (1 << b)
            else:
                sure, open_, need = sure | high, open_ & ~slices[b], need - n
        # a row's exact score exceeds its coarse one by at most this (in coarse units, rounded up)
        slack = sum(map(abs, query.tolist())) * ((1 << self.drop) - 1)
        floor = bound - -(-slack // (1 << self.drop))
        if floor <= 0:
            return np.arange(self.rows)
        above, equal = np.zeros_like(self.live), self.live
        for b in range(max(len(slices), floor.bit_length()) - 1, -1, -1):
            on = slices[b] if b < len(slices) else np.zeros_like(self.live)
            if floor >> b & 1:
                equal = equal & on
            else:
                above, equal = above | (equal & on), equal & ~on
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[:self.rows])

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than ``own``, ties to the smaller id."""
        rows = self.search(query, k + 1 if own is not None else k)
        scores = exact(self.values[rows], query, self.largest)
        found = ids[rows]
        if own is not None:
            keep = found != own
            if keep.sum() < min(k, (ids != own).sum()):  # the query's id stands in several rows
                rows = np.flatnonzero(ids != own)
                scores, found = exact(self.values[rows], query, self.largest), ids[rows]
            else:
                scores, found = scores[keep], found[keep]
        if scores.dtype == object:
            order = np.array(sorted(range(len(found)), key=lambda i: (-scores[i], found[i])), dtype=int)[:k]
        else:
            order = np.lexsort((found, -scores))[:k]
        return found[order], scores[order]


def exact(values: np.ndarray, query: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products of values up to ``largest``; big integers where 64 bits could overflow,
    saturated to a long."""
    if largest * float(np.abs(query.astype(np.float64)).sum()) < 2.0**62:
        return values.astype(np.int64) @ query
    sums = values.astype(object) @ query.astype(object)
    return np.array([min(max(s, -2**63), 2**63 - 1) for s in sums], dtype=object)


#: Stands for a null vec_id: sorts last.
_NO_ID = np.iinfo(np.int64).max


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, block_rows: int = BLOCK_ROWS,
          query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """The k best rows of ``vectors`` (id, q) for each row of ``queries`` (id, q), itself left out.

    Returns query_id, rank (from 1), vec_id, score.
    """
    vectors, queries = written(vectors, "topk-vectors"), written(queries, "topk-queries")
    n_blocks = max(1, -(-vectors.count() // block_rows))
    n_chunks = max(1, -(-queries.count() // query_chunk))
    spread = lambda n, salt: F.pmod(F.xxhash64("id", "q", F.lit(salt)), F.lit(n)).cast("int")
    rows = vectors.select("id", "q", F.size("q").alias("dims"), spread(n_blocks, 3).alias("block"))
    asked = queries.distinct().select("id", "q", F.size("q").alias("dims"), spread(n_chunks, 5).alias("chunk"),
                                      F.xxhash64("q").alias("query"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def matrix(table):
        n = table.num_rows
        values = table.column("q").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = table.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        return ids, flat.reshape(n, -1) if n else flat.reshape(0, 0)

    def answer(left, right):
        import pyarrow as pa
        cols = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, values = matrix(left)
            index = BlockIndex(values)
            asked_ids, asked_values = matrix(right)
            for own, name, query in zip(asked_ids.tolist(), right.column("query").to_pylist(), asked_values, strict=True):
                found, scores = index.top(query, k, ids, own)
                cols["query_id"] += [own] * len(found)
                cols["query"] += [name] * len(found)
                cols["vec_id"] += found.tolist()
                cols["score"] += scores.tolist()
        return pa.table({n: pa.array([None if v == _NO_ID and n.endswith("_id") else v for v in c], pa.int64())
                         for n, c in cols.items()})

    keys = ["block", "chunk", "dims"]
    found = (rows.groupBy(*keys).cogroup(asked.groupBy(*keys))
             .applyInArrow(answer, "query_id long, query long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
