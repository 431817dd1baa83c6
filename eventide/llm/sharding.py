"""Sharding by histogram sort: exact byte counts below probed keys, refined until splitters fit.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours.  The
splitters between shards are found by counting: a round counts, over all partitions, the exact
bytes in each of 4096 equal key ranges (partial sums per task, one small row per range to the
driver) and looks only inside the ranges where a shard's end falls; the next round probes those
ranges again, finer.  It ends as soon as every splitter is within the tolerance.  Only then do rows
move, once, to their shard.

Groups (equal texts): a splitter lies between texts where one within ``group_tolerance`` of a
shard's bytes exists; only a group too large for that is divided, by the hash of its ids.

Defined cases
* null or empty text: the caller's size says what it weighs (the query: 1 byte); null keys hash
  like any other value;
* very long text: no shard can be more even than its largest row allows; the nearest key counts;
* ties and repeated rows: neighbours with one key; they are divided only between shards by ids;
* empty table: empty result; fewer rows than shards: some shards stay empty;
* extra columns are kept; helper columns take free names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import discard, free_name, small, written

N_SHARDS = 16
#: Share of a shard's bytes by which a splitter may miss.
TOLERANCE = 0.002
#: The same where equal texts would else be divided.
GROUP_TOLERANCE = 0.025
#: Rows that one task numbers inside a shard.
ROWS_PER_RUN = 100_000
_BITS, _STEP = 63, 12


def _hash(*cols) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def _close(cells, shift, targets_in, want, best, edge, limit):
    """Look at a range's counted cells: note the nearest edge of every target, return the cells
    that still hold a target farther than ``limit`` from any edge."""
    finer, (below, targets) = {}, targets_in
    for p, size in sorted(cells):
        inside = []
        for t in targets:
            if below <= want[t] < below + size:
                best[t] = min(best[t], (want[t] - below, edge(p << shift)), (below + size - want[t], edge((p + 1) << shift)))
                if best[t][0] > limit:
                    inside.append(t)
        if inside:
            finer[p] = (below, inside)
        below += size
    return finer


def splitters(keys: DataFrame, n_shards: int, tolerance: float, group_tolerance: float) -> list[tuple[int, int]]:
    """First (k1, k2) of each shard but the first; ``keys`` has k1, k2 (63 bits) and size.

    The driver sees at most 4096 counts per splitter and round.
    """
    share = (keys.agg(F.sum("size")).first()[0] or 0) / n_shards
    want = [j * share for j in range(1, n_shards)]
    best = [(math.inf, (1 << _BITS, 0))] * len(want)
    shifts = [*range(_BITS - _STEP, 0, -_STEP), 0]
    open_, up = {0: (0, list(range(len(want))))}, _BITS
    for shift in shifts:  # between texts
        rows = keys if up == _BITS else keys.where(F.shiftright("k1", up).isin(list(open_)))
        cells: dict = {}
        for p, size in rows.groupBy(F.shiftright("k1", shift).alias("p")).agg(F.sum("size")).collect():
            cells.setdefault(p >> (up - shift), []).append((p, size))
        limit = share * (tolerance if shift else group_tolerance)
        finer = {}
        for name, state in open_.items():
            finer |= _close(cells.get(name, []), shift, state, want, best, lambda k: (k, 0), limit)
        open_, up = finer, shift
        if not open_:
            break
    open_, up = {(k1, 0): state for k1, state in open_.items()}, _BITS
    for shift in shifts if open_ else ():  # inside a large group of equal texts
        mine = F.lit(False)
        for k1, p in open_:
            mine = mine | ((F.col("k1") == k1) & (F.shiftright("k2", up) == p if up < _BITS else F.lit(True)))
        cells = {}
        for k1, p, size in keys.where(mine).groupBy("k1", F.shiftright("k2", shift).alias("p")).agg(F.sum("size")).collect():
            cells.setdefault((k1, p >> (up - shift)), []).append((p, size))
        finer = {}
        for (k1, name), state in open_.items():
            found = _close(cells.get((k1, name), []), shift, state, want, best,
                           lambda k, k1=k1: (k1, k) if k < 1 << _BITS else (k1 + 1, 0), share * tolerance)
            finer |= {(k1, p): s for p, s in found.items()}
        open_, up = finer, shift
        if not open_:
            break
    return sorted(edge for _, edge in best)


def shard(df: DataFrame, *, group: str, tie: str, size: str, n_shards: int = N_SHARDS, tolerance: float = TOLERANCE,
          group_tolerance: float = GROUP_TOLERANCE, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """``df`` plus ``shard`` (0 up) and ``slot`` (0 up inside the shard, in key order).

    ``group``: column whose equal values should stay together; ``tie``: orders a group's rows;
    ``size``: bytes of a row (above 0).
    """
    k1, k2 = free_name(df, "shard_k1"), free_name(df, "shard_k2")
    keyed = df.withColumns({k1: _hash(F.col(group)), k2: _hash(F.col(tie), F.lit(7))})
    keys = written(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(size).cast("long").alias("size")), "shard-keys")
    cuts = splitters(keys, n_shards, tolerance, group_tolerance)

    def shard_of(a, b):
        return sum(((F.col(a) > x) | ((F.col(a) == x) & (F.col(b) >= y)) if x < 1 << _BITS else F.lit(False)).cast("int")
                   for x, y in cuts) if cuts else F.lit(0)

    # runs: key ranges of about rows_per_run rows, numbered side by side; where one text is most of
    # a range, the text's rows are runs of their own, cut by k2
    n = keys.count()
    bits = min(20, max(0, math.ceil(math.log2(max(1, n / rows_per_run)))))
    head = lambda c: F.shiftright(c, _BITS - bits) if bits else F.lit(0).cast("long")
    crowded = keys.groupBy(head("k1").alias("head")).count().where(F.col("count") > 4 * rows_per_run).select("head")
    crowded = small(written(crowded, "shard-crowded"), 1 << bits)
    hot = (keys.withColumn("head", head("k1")).join(crowded, "head").groupBy("head", "k1").count().where(F.col("count") > rows_per_run)
           .groupBy("head").agg(F.max_by("k1", "count").alias("hot"), F.max("count").alias("count")))
    hot = written(hot.select("head", "hot", F.ceil(F.log2(F.col("count") / rows_per_run)).cast("int").alias("more")), "shard-hot")
    hot = small(hot, hot.count())

    def runs(rows, a, b, names):
        run1, run2, text, more = names
        far = hot.select(F.col("head").alias(run1), F.col("hot").alias(text), F.col("more").alias(more))
        return (rows.withColumn(run1, head(a)).join(far, run1, "left")
                .withColumn(run2, F.when(F.col(text).isNull() | (F.col(a) < F.col(text)), F.lit(-1).cast("long"))
                            .when(F.col(a) > F.col(text), F.lit(1 << 40))
                            .otherwise(F.expr(f"shiftright(`{b}`, {_BITS} - `{more}`)"))).drop(text, more))

    counts = (runs(keys.withColumn("shard", shard_of("k1", "k2")), "k1", "k2", ("run1", "run2", "text", "more"))
              .groupBy("shard", "run1", "run2").count())
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("run1", "run2")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("before", before).drop("count"), "shard-runs")
    run1, run2, text, more, first = (free_name(df, f"shard_{x}") for x in ("run1", "run2", "text", "more", "first"))
    place = keyed.drop(*[c for c in ("shard", "slot") if c in df.columns]).withColumn("shard", shard_of(k1, k2).cast("int"))
    place = runs(place, k1, k2, (run1, run2, text, more))
    at = F.row_number().over(Window.partitionBy("shard", run1, run2).orderBy(k1, k2)) - 1
    starts = small(counts.select("shard", F.col("run1").alias(run1), F.col("run2").alias(run2), F.col("before").alias(first)),
                   counts.count())
    out = place.withColumn("slot", at).join(starts, ["shard", run1, run2])
    discard(keys)
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    return out.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("slot") + F.col(first)).cast("long").alias("slot"))
