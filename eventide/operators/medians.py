"""First event time at which a falling survival curve reaches a level, for models that only answer
"S at these times" (forests, Bayesian models).

The event times form a tree with ``WAYS`` children a node, by rank.  A row starts at the root; one round
asks the model for S at the last time of every child of the row's node, and the row moves to the first
child whose last time has S at the level or below.  Since S never rises, that child holds the first crossing.
The rounds are log(event times) to the base ``WAYS``: 3 up to 262,144 event times, 4 up to 16 million,
each over at most ``WAYS`` times a row, so the answer is exact at every size.  Separators are a table
joined by node, broadcast only while counted small.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.plans.scan import cumulative

#: Children of a node: times that one round asks for per row.
WAYS = 64


def event_times(df: DataFrame, time: str, event: str) -> DataFrame:
    """(time): the distinct event times."""
    return df.where(F.col(event) > 0).select(F.col(time).cast("double").alias("time")).where("time IS NOT NULL").distinct()


def first_at_level(rows: DataFrame, key: str, times: DataFrame, survival_at: Callable[[DataFrame, str, list], DataFrame],
                   level: float = 0.5, ways: int = WAYS) -> DataFrame:
    """(key, median_time): the first of ``times`` (column time) with S <= ``level``, +inf if there is none.

    ``survival_at(rows, column, keep)`` returns keep..., ``_s``: S at the times in the array ``column`` of each row.
    """
    from eventide.operators.relational import maybe_broadcast
    from eventide.session import cut_lineage
    ranked = cumulative(times.withColumn("_one", F.lit(1)), "time", [], sums={"_r": "_one"}).select(
        "time", (F.col("_r").cast("long") - 1).alias("_r")).persist(StorageLevel.MEMORY_AND_DISK)
    n = ranked.count()
    if not n:
        return rows.select(key, F.lit(math.inf).alias("median_time"))
    depth = 1
    while ways ** depth < n:
        depth += 1
    at = rows.withColumn("_node", F.lit(0).cast("long"))  # null: never
    done = []
    for left in range(depth - 1, -1, -1):
        child = F.floor(F.col("_r") / F.lit(ways ** left)).cast("long")
        ends = ranked.groupBy(child.alias("_child")).agg(F.max("time").alias("_end")) if left else ranked.select(
            F.col("_r").alias("_child"), F.col("time").alias("_end"))
        # children of a node are consecutive, so their ends in order are the separators
        nodes = ends.groupBy(F.floor(F.col("_child") / F.lit(ways)).cast("long").alias("_node")).agg(
            F.sort_array(F.collect_list("_end")).alias("_at"))
        asked = at.join(maybe_broadcast(nodes), "_node")
        got = survival_at(asked, "_at", [key, "_node"])
        # 1-based, 0 if no child reaches the level: only at the root, as below it the last child does (but for rounding)
        step = F.array_position(F.transform("_s", lambda s: s <= level), True)
        if left < depth - 1:
            step = F.when(step == 0, F.size("_s")).otherwise(step)
        got = cut_lineage(got.select(F.col(key).alias("_k"), F.col("_node").alias("_from"), step.alias("_step")))
        done.append(got.where("_step = 0").select(F.col("_k").alias(key), F.lit(math.inf).alias("median_time")))
        moved = got.where("_step > 0").select("_k", (F.col("_from") * ways + F.col("_step") - 1).alias("_node"))
        if left:
            at = rows.join(moved.distinct(), F.col(key).eqNullSafe(F.col("_k"))).drop("_k")
    out = moved.join(maybe_broadcast(ranked), F.col("_node") == F.col("_r")).select(F.col("_k").alias(key), F.col("time").alias("median_time"))
    for more in done:
        out = out.unionByName(more)
    return out
