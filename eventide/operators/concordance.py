"""Exact Harrell concordance without a self join.

A pair (i, j) is comparable when i has the event and T_i < T_j, or
T_i = T_j with j censored.  It is concordant when risk_i > risk_j,
discordant when risk_i < risk_j, and a risk tie counts one half.

Plan (all pair counts exact):
1. pre-aggregate equal (time, event, risk) with a weight;
2. cut time into key buckets and risk into risk buckets (quantiles; a value
   heavy enough to be a cut gets its own bucket);
3. pairs in different key *and* different risk buckets come from the
   (bucket x bucket) count matrix; a large one is summed over blocks of buckets first, and the pairs
   inside a block are counted by the same three kinds of groups as below (``_cross_tree``).  The number of
   buckets grows with the rows, without a cap;
4. pairs in the same risk bucket: one group per risk bucket, over exact keys.  So there are as many
   groups as buckets, not as cells;
5. pairs in the same key bucket but different risk buckets: one group per key
   bucket over rows pre-aggregated to (key, risk bucket) — a key bucket made of
   one heavy time value holds only ~2 x buckets rows;
6. a risk bucket that one heavy value fills is cut: one group per key bucket of it, and the pairs
   of different key buckets over rows pre-aggregated to (key bucket, risk, event).
Steps 4-6 count 2-D dominance inside a group with a vectorised
divide-and-conquer over key ranks (numpy sorts and searchsorted, no Python
loop per row) in ``applyInPandas``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_GROUP = 20_000
# From this many buckets on, groups grow to MAX_ROWS_PER_GROUP rows before there are more buckets.
FEW_BUCKETS = 32
MAX_ROWS_PER_GROUP = 200_000
# Rows of a group of ``replicate_counts`` (each row carries the weights of all replicates), and the
# replicates counted at once.
REPLICATE_ROWS = 400_000
REPLICATE_BLOCK = 10
# (groups x buckets^2) cell matrices up to this size are summed with numpy on the driver; of larger ones
# only the matrix of blocks of buckets is (``_cross_tree``).
DRIVER_CELLS = 1_000_000
# Tables of group sizes up to this many rows are broadcast.
BROADCAST_GROUPS = 500_000


def dominance_counts(rank: np.ndarray, risk_rank: np.ndarray, w: np.ndarray,
                     query_w: np.ndarray) -> tuple[float, float, float]:
    """Sum over query rows i of query_w[i] times the weight of rows j with rank_j < rank_i
    and risk_j < / > / == risk_i.  Returns (concordant, discordant, tied)."""
    n = len(rank)
    if n == 0:
        return 0.0, 0.0, 0.0
    R = int(risk_rank.max()) + 1
    K = int(rank.max()) + 1
    conc = disc = tied = 0.0
    s = 1
    while s < K:
        block = rank // (2 * s)
        left = ((rank // s) % 2) == 0
        lm = left & (w > 0)
        qm = (~left) & (query_w > 0)
        if lm.any() and qm.any():
            lv = block[lm].astype(np.int64) * R + risk_rank[lm]
            order = np.argsort(lv, kind="stable")
            lv = lv[order]
            cw = np.concatenate([[0.0], np.cumsum(w[lm][order])])
            qb = block[qm].astype(np.int64) * R
            qv = qb + risk_rank[qm]
            start = cw[np.searchsorted(lv, qb, "left")]
            end = cw[np.searchsorted(lv, qb + R, "left")]
            less = cw[np.searchsorted(lv, qv, "left")] - start
            leq = cw[np.searchsorted(lv, qv, "right")] - start
            qw = query_w[qm]
            conc += float(np.dot(qw, less))
            tied += float(np.dot(qw, leq - less))
            disc += float(np.dot(qw, (end - start) - leq))
        s *= 2
    return conc, disc, tied


def _group_counts(pdf: pd.DataFrame, by_key_rank: bool) -> pd.DataFrame:
    if pdf.empty:
        return pd.DataFrame({"conc": [0.0], "disc": [0.0], "tied": [0.0]})
    if by_key_rank:
        # key = (time asc, censored after event); contributors have a larger key
        order = np.lexsort((-(1 - pdf["event"].to_numpy()), -pdf["time"].to_numpy()))
        t = pdf["time"].to_numpy()[order]
        ce = (1 - pdf["event"].to_numpy())[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (ce[1:] != ce[:-1])])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(new) - 1
    else:
        # different key buckets only: a larger key bucket contributes
        kb = pdf["kb"].to_numpy()
        rank = (kb.max() - kb).astype(np.int64)
    risk = pdf["risk"].to_numpy()
    _, risk_rank = np.unique(risk, return_inverse=True)
    w = pdf["w"].to_numpy().astype(float)
    qw = np.where(pdf["event"].to_numpy() == 1, w, 0.0)
    c, d, t = dominance_counts(rank, risk_rank.astype(np.int64), w, qw)
    return pd.DataFrame({"conc": [c], "disc": [d], "tied": [t]})


def _splits(df: DataFrame, col: str, n: int) -> list[float]:
    if n <= 1:
        return [-math.inf, math.inf]
    cuts = df.approxQuantile(col, [i / n for i in range(1, n)], 1.0 / (4 * n))
    b = set()
    for c in cuts:
        c = float(c)
        b.add(c)
        b.add(float(np.nextafter(c, math.inf)))  # isolate heavy values in their own bucket
    return [-math.inf] + sorted(b) + [math.inf]


def _splits2(df: DataFrame, cols: list[str], n: int) -> list[list[float]]:
    """Bucket splits of several columns from one quantile job."""
    if n <= 1:
        return [[-math.inf, math.inf] for _ in cols]
    qs = df.approxQuantile(cols, [i / n for i in range(1, n)], 1.0 / (4 * n))
    out = []
    for cuts in qs:
        b = set()
        for c in cuts:
            b.add(float(c))
            b.add(float(np.nextafter(float(c), math.inf)))  # isolate heavy values in their own bucket
        out.append([-math.inf] + sorted(b) + [math.inf])
    return out


def _bucket_count(rows: int) -> int:
    return max(1, min(math.ceil(rows / ROWS_PER_GROUP), FEW_BUCKETS), math.ceil(rows / max(ROWS_PER_GROUP, MAX_ROWS_PER_GROUP)))


def _singles(splits: list[float]) -> list[int]:
    """Buckets of one value."""
    return [i for i, (a, b) in enumerate(zip(splits, splits[1:])) if b == np.nextafter(a, math.inf)]


def _bucketed(df: DataFrame, ks: list[float], rs: list[float]) -> DataFrame:
    """``df`` with time bucket ``kb`` and risk bucket ``rb``; a missing time is the earliest and a missing
    risk the highest, as inside a group."""
    gb = _bucket(_bucket(df, "time", "kb", ks), "risk", "rb", rs)
    kb, rb = F.col("kb"), F.col("rb")
    return gb.withColumns({"kb": F.when(kb < len(ks) - 1, kb).otherwise(0), "rb": F.least(rb, F.lit(len(rs) - 2))})


def _bucket(df: DataFrame, col: str, out: str, splits: list[float]) -> DataFrame:
    if len(splits) <= 2:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def concordance(df: DataFrame, time: str = "t", event: str = "e", risk: str = "risk",
                weight: str | None = None, n_buckets: int | None = None) -> dict:
    """Concordance index with pair counts (higher risk should mean earlier event)."""
    r = concordance_by(df, [], time, event, risk, weight, n_buckets).first()
    return r.asDict()


def concordance_by(df: DataFrame, by: list[str], time: str = "t", event: str = "e",
                   risk: str = "risk", weight: str | None = None,
                   n_buckets: int | None = None) -> DataFrame:
    """Concordance per group of ``by`` (e.g. bootstrap replicate, cohort period).

    Returns by..., c_index, concordant, discordant, tied_risk, tied_time, comparable.
    """
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = (df.groupBy(*by, F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
                    F.col(risk).cast("double").alias("risk"))
         .agg(F.sum(w).alias("w")).where(F.col("w") > 0))
    g = g.persist()
    n = g.count()
    n_groups, few = 1, None
    large = g
    if by:
        sizes = g.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        n_groups, largest = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
        if n_buckets is None and (largest or 0) > ROWS_PER_GROUP:  # groups of few rows are not cut
            few = F.col("_n") <= ROWS_PER_GROUP
            sizes = sizes.select("_n", *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
            same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])
            sized = g.join(F.broadcast(sizes) if n_groups <= BROADCAST_GROUPS else sizes, same).drop(*[f"_by{i}" for i in range(len(by))])
            large = sized.where(~few)
            # all rows of large groups: one of them may hold a whole bucket
            n_buckets = _bucket_count(large.count())
    if n_buckets is None:
        n_buckets = 1 if by else _bucket_count(n)
    ks, rs = _splits2(large, ["time", "risk"], n_buckets)
    if few is None:
        gb = _bucketed(g, ks, rs)
    else:
        gb = _bucketed(sized, ks, rs).withColumns({c: F.when(few, 0).otherwise(F.col(c)) for c in ("kb", "rb")}).drop("_n")
    nk, nr = len(ks) - 1, len(rs) - 1
    # cross-bucket pairs from the (bucket x bucket) matrix of each group: bounded numbers
    cells = gb.groupBy(*by, "kb", "rb").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("w").alias("n_all"),
        F.sum(F.when(F.col("event") == 1, F.col("w")).otherwise(0.0)).alias("n_ev")).persist()
    if n_groups * nk * nr <= DRIVER_CELLS:
        cross = _cross_driver(cells, by, nk, nr)
    else:
        cross = _cross_tree(cells, by, nk, nr, max(2, math.isqrt(DRIVER_CELLS // n_groups)))
    schema_by = ", ".join(f"{b} {g.schema[b].dataType.simpleString()}" for b in by)
    schema = (schema_by + ", " if by else "") + "conc double, disc double, tied double"
    cols = [*by, "time", "event", "risk", "w", "kb"]

    def run(p, by_key_rank):
        out = _group_counts(p, by_key_rank)
        for b in by:
            out[b] = p[b].iloc[0] if len(p) else None
        return out[[*by, "conc", "disc", "tied"]]

    # (c) same risk bucket: exact keys and risks; one value that fills a bucket is cut by time bucket
    heavy = []
    if n_buckets > 1:
        limit = 2 * max(1, math.ceil(n / n_buckets))
        heavy = [r["rb"] for r in cells.where(F.col("rb").isin(_singles(rs))).groupBy(*by, "rb").agg(F.sum("rows").alias("rows"))
                 .where(F.col("rows") > limit).select("rb").distinct().collect()]  # at most groups x buckets / 2
    piece = F.when(F.col("rb").isin(heavy), F.col("kb")).otherwise(-1) if heavy else F.lit(-1)
    same_risk = (gb.select(*cols, "rb").withColumn("piece", piece).groupBy(*by, "rb", "piece")
                 .applyInPandas(lambda p: run(p, True), schema))
    # (d) same time bucket, different risk buckets: pre-aggregate to (key, risk bucket) first, so a
    #     time bucket holding one heavy time value ships ~2 x buckets rows; risk-bucket ties are
    #     cell pairs already counted in (c) and are dropped
    cellagg = (gb.groupBy(*by, "kb", "time", "event", "rb").agg(F.sum("w").alias("w"))
               .withColumn("risk", F.col("rb").cast("double")))

    def run_d(p):
        out = run(p, True)
        out["tied"] = 0.0
        return out

    same_k = cellagg.select(*cols).groupBy(*by, "kb").applyInPandas(run_d, schema)
    local = same_risk.unionByName(same_k)
    if heavy:
        # (b) heavy risk bucket, different time buckets: the time-bucket index orders the pairs, so rows are
        #     first summed over the times of a time bucket
        riskagg = (gb.where(F.col("rb").isin(heavy)).groupBy(*by, "rb", "kb", "risk", "event").agg(F.sum("w").alias("w"))
                   .withColumn("time", F.lit(0.0)))
        local = local.unionByName(riskagg.select(*cols, "rb").groupBy(*by, "rb").applyInPandas(lambda p: run(p, False), schema))
    local = local.groupBy(*by).agg(F.sum("conc").alias("c"), F.sum("disc").alias("d"), F.sum("tied").alias("t"))
    ttime = (gb.where("event = 1").groupBy(*by, "time").agg(F.sum("w").alias("d"))
             .groupBy(*by).agg(F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("tt")))
    rows = []
    tmap = {tuple(r[b] for b in by): r["tt"] for r in ttime.collect()}
    for r in local.collect():
        k = tuple(r[b] for b in by)
        c0, d0 = cross.get(k, (0.0, 0.0))
        conc, disc, tied = c0 + (r["c"] or 0.0), d0 + (r["d"] or 0.0), r["t"] or 0.0
        comp = conc + disc + tied
        ci = (conc + 0.5 * tied) / comp if comp > 0 else float("nan")
        rows.append((*k, ci, conc, disc, tied, float(tmap.get(k) or 0.0), comp))
    g.unpersist()
    cells.unpersist()
    out_schema = (schema_by + ", " if by else "") + ("c_index double, concordant double, discordant double, "
                                                     "tied_risk double, tied_time double, comparable double")
    return df.sparkSession.createDataFrame(rows, out_schema)


def _cross_driver(cells: DataFrame, by: list[str], nk: int, nr: int) -> dict:
    mats = {}
    for r in cells.collect():  # at most DRIVER_CELLS rows
        k = tuple(r[b] for b in by)
        if k not in mats:
            mats[k] = (np.zeros((nk, nr)), np.zeros((nk, nr)))
        mats[k][0][r["kb"], r["rb"]] = r["n_all"]
        mats[k][1][r["kb"], r["rb"]] = r["n_ev"]
    cross = {}
    for k, (A, Ev) in mats.items():
        G = np.cumsum(A[::-1], axis=0)[::-1]
        G = np.vstack([G[1:], np.zeros((1, nr))])          # rows kb' > kb
        below = np.cumsum(G, axis=1) - G                      # columns rb' < rb
        above = G.sum(axis=1, keepdims=True) - np.cumsum(G, axis=1)  # columns rb' > rb
        cross[k] = (float((Ev * below).sum()), float((Ev * above).sum()))
    return cross


def _strict_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of cells (kb, rb, n_all, n_ev) that differ in both buckets."""
    kb, rb = pdf["kb"].to_numpy(), pdf["rb"].to_numpy()
    _, rank = np.unique(-kb, return_inverse=True)  # a larger time bucket contributes
    _, risk_rank = np.unique(rb, return_inverse=True)
    c, d, _ = dominance_counts(rank.astype(np.int64), risk_rank.astype(np.int64), pdf["n_all"].to_numpy(float), pdf["n_ev"].to_numpy(float))
    return pd.DataFrame({"c": [c], "d": [d]})


def _cross_tree(cells: DataFrame, by: list[str], nk: int, nr: int, side: int) -> dict:
    """Same sums as ``_cross_driver`` for any number of buckets: both kinds are joined to at most ``side``
    blocks.  Pairs of different time blocks and risk blocks come from the (block x block) matrix; of the
    rest, pairs inside one cell of blocks, in one time block (over rows summed to its buckets x risk
    blocks) and in one risk block (time blocks x its buckets) are one group each, so a group holds at
    most about ``side`` x buckets / ``side`` cells."""
    n = ["n_all", "n_ev"]
    x = cells.withColumns({"K": F.floor(F.col("kb") / -(-nk // side)).cast("int"), "R": F.floor(F.col("rb") / -(-nr // side)).cast("int")})
    total = _cross_driver(x.groupBy(*by, F.col("K").alias("kb"), F.col("R").alias("rb")).agg(*[F.sum(c).alias(c) for c in n]), by, side, side)
    schema = "".join(f"{b} {cells.schema[b].dataType.simpleString()}, " for b in by) + "c double, d double"

    def run(pdf):
        out = _strict_counts(pdf)
        for b in by:
            out[b] = pdf[b].iloc[0]
        return out[[*by, "c", "d"]]

    inside = x.select(*by, "K", "R", "kb", "rb", *n).groupBy(*by, "K", "R").applyInPandas(run, schema)
    same_k = x.groupBy(*by, "K", "kb", F.col("R").alias("rb")).agg(*[F.sum(c).alias(c) for c in n]).groupBy(*by, "K").applyInPandas(run, schema)
    same_r = x.groupBy(*by, "R", F.col("K").alias("kb"), "rb").agg(*[F.sum(c).alias(c) for c in n]).groupBy(*by, "R").applyInPandas(run, schema)
    rest = inside.unionByName(same_k).unionByName(same_r).groupBy(*by).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    for r in rest.collect():
        k = tuple(r[b] for b in by)
        c, d = total.get(k, (0.0, 0.0))
        total[k] = c + r["c"], d + r["d"]
    return total


def concordance_table(df: DataFrame, time: str = "t", event: str = "e", risk: str = "risk",
                      **kw) -> DataFrame:
    return concordance_by(df, [], time, event, risk, **kw)


def _dominance_many(rank: np.ndarray, risk_rank: np.ndarray, w: np.ndarray, event: np.ndarray) -> np.ndarray:
    """``dominance_counts`` for each column of the weights ``w`` (rows x replicates), 3 x replicates:
    sorts and searches are made once a level, sums for a few replicates at a time."""
    out = np.zeros((3, w.shape[1]))
    by_risk = np.argsort(risk_rank, kind="stable")
    rank, risk_rank, w, event = rank[by_risk], risk_rank[by_risk], w[by_risk], event[by_risk]
    top, s = int(risk_rank.max()) + 1, 1
    while s <= int(rank.max()):
        block, right = rank // (2 * s), (rank // s) % 2 == 1
        later, asked = np.flatnonzero(~right), np.flatnonzero(right & event)
        s *= 2
        if not len(later) or not len(asked):
            continue
        later = later[np.argsort(block[later], kind="stable")]
        at = block[later] * top + risk_rank[later]
        first = block[asked] * top
        places = [np.searchsorted(at, v, side) for v, side in ((first, "left"), (first + risk_rank[asked], "left"),
                                                               (first + risk_rank[asked], "right"), (first + top, "left"))]
        for j in range(0, w.shape[1], REPLICATE_BLOCK):
            cols = slice(j, j + REPLICATE_BLOCK)
            run = np.zeros((len(later) + 1, w[:, cols].shape[1]))
            np.cumsum(w[later, cols], axis=0, out=run[1:])
            q = w[asked, cols].astype(float)
            start, less, upto, end = (np.einsum("ij,ij->j", q, run[x]) for x in places)
            out[:, cols] += less - start, end - upto, upto - less
    return out


def replicate_counts(df: DataFrame, n_boot: int, draw, id_col: str = "id", time: str = "t", event: str = "e", risk: str = "risk",
                     n_buckets: int | None = None) -> list:
    """Rows (rep, weight, conc, disc, tied), one a replicate: pair counts of ``n_boot`` weightings of the same rows.

    ``draw(ids)`` gives the weights (ids x replicates, bytes) of ids as text.  A row carries its weights as one
    binary value, so rows are never copied once a replicate: they are shuffled to their risk bucket and to
    their time bucket, and a group counts all replicates.  Pairs that differ in both buckets come from the
    count matrix of each replicate.  A bucket that one heavy value fills is cut, and its pairs come from
    the matrix too.
    """
    import pyarrow as pa
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(time).cast("double").alias("time"),
                     F.col(event).cast("int").alias("event"), F.col(risk).cast("double").alias("risk"))
    if n_buckets is None:
        n = rows.count()
        n_buckets = max(1, min(math.ceil(n / ROWS_PER_GROUP), FEW_BUCKETS), math.ceil(n / REPLICATE_ROWS))
    ks, rs = _splits2(rows, ["time", "risk"], n_buckets)
    nk, nr = len(ks) - 1, len(rs) - 1
    rows = _bucketed(rows, ks, rs)

    def weighted(batches):
        for b in batches:
            w = draw(b.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r.tobytes() for r in w], pa.binary())], names=[*b.schema.names[1:], "w"])

    x = rows.mapInArrow(weighted, "time double, event int, risk double, kb int, rb int, w binary").persist(StorageLevel.MEMORY_AND_DISK)
    heavy = {"kb": [], "rb": []}
    if n_buckets > 1:
        for c, splits in (("kb", ks), ("rb", rs)):
            sizes = x.groupBy(c).count().collect()  # one row a bucket
            limit = 2 * sum(r["count"] for r in sizes) / n_buckets
            heavy[c] = sorted({r[c] for r in sizes if r["count"] > limit} & set(_singles(splits)))

    def read(table):
        num = lambda c: table.column(c).to_numpy().astype(float)
        w = np.frombuffer(b"".join(table.column("w").to_pylist()), np.uint8).reshape(table.num_rows, n_boot)
        return num("time"), num("event"), num("rb"), table.column("kb").to_numpy(), w

    def ranked(t, e):
        order = np.lexsort((-(1 - e), -t))
        new = np.concatenate([[True], (t[order][1:] != t[order][:-1]) | (e[order][1:] != e[order][:-1])])
        rank = np.empty(len(t), np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def answer(kb, rb, **values):
        """One row a cell: lists over all replicates."""
        names = ["n_all", "n_ev", "n_cens", "conc", "disc", "tied"]
        cell = {k: pa.array(values.get(k, [None] * len(kb)), pa.list_(pa.float64())) for k in names}
        return pa.table({"kb": pa.array(kb, pa.int32()), "rb": pa.array(rb, pa.int32()), **cell})

    schema = "kb int, rb int, " + ", ".join(f"{k} array<double>" for k in ("n_all", "n_ev", "n_cens", "conc", "disc", "tied"))

    def same_risk(table):
        t, e, rb, kb, w = read(table)
        cells, at = np.unique(kb, return_inverse=True)
        sums = {k: [w[(at == i) & ok].sum(axis=0, dtype=float) for i in range(len(cells))]
                for k, ok in (("n_all", np.ones(len(e), bool)), ("n_ev", e == 1), ("n_cens", e == 0))}
        pairs = np.zeros((3, n_boot))
        if not (int(rb[0]) in heavy["rb"] and int(kb[0]) in heavy["kb"]):  # else one time and one risk
            risk = table.column("risk").to_numpy().astype(float)
            pairs = _dominance_many(ranked(t, e), np.unique(risk, return_inverse=True)[1].astype(np.int64), w, e == 1)
        once = [[p] + [None] * (len(cells) - 1) for p in pairs]
        return answer(cells, np.full(len(cells), int(rb[0])), **sums, conc=once[0], disc=once[1], tied=once[2])

    def same_time(table):
        t, e, rb, kb, w = read(table)
        conc, disc, _ = _dominance_many(ranked(t, e), np.unique(rb, return_inverse=True)[1].astype(np.int64), w, e == 1)
        return answer(kb[:1], [-1], conc=[conc], disc=[disc])

    heavy_k, heavy_r = (F.col(c).isin(heavy[c]) if heavy[c] else F.lit(False) for c in ("kb", "rb"))
    piece = F.when(heavy_r, F.col("kb")).otherwise(-1)
    salt = F.when(heavy_r & heavy_k, F.pmod(F.hash("w"), F.lit(n_buckets))).otherwise(0)
    parts = x.withColumns({"piece": piece, "salt": salt}).groupBy("rb", "piece", "salt").applyInArrow(same_risk, schema)
    if nr > 1:
        parts = parts.unionByName(x.where(~heavy_k).groupBy("kb").applyInArrow(same_time, schema))
    lists = [F.coalesce(c, F.array_repeat(F.lit(0.0), n_boot)).alias(c) for c in ("n_all", "n_ev", "n_cens", "conc", "disc", "tied")]
    one = F.posexplode(F.arrays_zip(*lists)).alias("rep", "v")
    each = parts.select("kb", "rb", one).select("rep", "kb", "rb", "v.*")

    def total(pdf):
        """Adds the pairs that the count matrix of one replicate gives."""
        kb, rb = pdf["kb"].to_numpy(), pdf["rb"].to_numpy()
        own = rb >= 0
        mats = []
        for c in ("n_all", "n_ev", "n_cens"):
            m = np.zeros((nk, nr))
            np.add.at(m, (kb[own], rb[own]), pdf[c].to_numpy()[own])
            mats.append(m)
        A, ev, cens = mats
        later = np.cumsum(A[::-1], axis=0)[::-1] - A
        before = lambda m: np.cumsum(m, axis=1) - m
        after = lambda m: m.sum(axis=1, keepdims=True) - np.cumsum(m, axis=1)
        conc, disc, tied = (pdf[c].sum() for c in ("conc", "disc", "tied"))
        conc += (ev * before(later)).sum()
        disc += (ev * after(later)).sum()
        tied += (ev * later)[:, heavy["rb"]].sum()
        conc += (ev * before(cens))[heavy["kb"]].sum()
        disc += (ev * after(cens))[heavy["kb"]].sum()
        tied += (ev * cens)[np.ix_(heavy["kb"], heavy["rb"])].sum()
        return pd.DataFrame({"rep": [pdf["rep"].iloc[0]], "weight": [A.sum()], "conc": [conc], "disc": [disc], "tied": [tied]})

    out = each.groupBy("rep").applyInPandas(total, "rep int, weight double, conc double, disc double, tied double").collect()
    x.unpersist()
    return out
