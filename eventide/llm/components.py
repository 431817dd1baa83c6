"""Connected components of a link table, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of its component.

    Each round every node points to its smallest neighbour if that is smaller than itself; the
    pointers form trees, pointer jumping turns each tree into a star, and the edges are drawn
    again between the stars' centres.  At least half of the nodes that still have edges go in
    each round.  Every round's tables are written to the shared folder and the previous ones
    deleted; nothing but counts reaches the driver.
    """
    links = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                    .where(F.col("a") != F.col("b")).distinct(), "cc-edges")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    roots = written(nodes.select("node", F.col("node").alias("root")), "cc-roots")
    while not links.isEmpty():
        # every node points to its smallest neighbour, or to itself if it is a local minimum
        point = written(links.select(F.col("b").alias("node"), F.col("a").alias("to"))
                        .union(links.select("a", "a"))
                        .groupBy("node").agg(F.min("to").alias("to")), "cc-point")
        while True:
            far = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = written(point.join(far, "to").select("node", F.col("far").alias("to"),
                                                          (F.col("far") != F.col("to")).alias("moved")), "cc-point")
            discard(point)
            point = jumped
            if point.where("moved").isEmpty():
                break
        point = point.select("node", "to")
        next_roots = written(roots.join(point.withColumnRenamed("node", "root"), "root", "left")
                             .select("node", F.coalesce("to", "root").alias("root")), "cc-roots")
        to_a, to_b = (point.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        next_links = written(links.join(to_a, "a").join(to_b, "b").where(F.col("to_a") != F.col("to_b"))
                             .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")
        for old in (roots, links, jumped):
            discard(old)
        roots, links = next_roots, next_links
    discard(links)
    return roots
