"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the least node reachable) for each node of edges(a, b).

    Each round writes the edges to the shared folder, so lineage stays short.
    A star's hub is only grouped with partial minima and joined, never
    collected.  Ends when a round changes nothing; rounds grow with the
    logarithm of the longest path.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # large star: neighbours greater than a node go to the least node around it
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its lesser neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, now = now, scratch.keep(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.free(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    labelled = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
