"""Connected components of an edge table, by alternating stars.

Each round attaches every node's larger neighbours to its least neighbour, then
its smaller ones; rounds go on until the edges stay as they are, when each node
hangs on the least node of its component.  Minima are aggregated before the
shuffle, and each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch


def _print(edges: DataFrame) -> tuple:
    """Count and sum of hashes: two numbers that tell edge sets apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_roots(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that isn't its component's least node.

    Direction, repeats and loops in ``edges`` do not matter; null ends take no part.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.keep(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while (seen := _print(now)) != before and seen[0]:
        before = seen
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        after = scratch.keep(small, "small")
        scratch.drop(now, large)
        now = after
    return now.select(a.alias("node"), b.alias("root"))
