"""Connected components of a graph held in a DataFrame, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cdsloom.llm.common import drop, stash


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v longs) reaches, roots left out.

    No partition ever holds more than its share: minima are combined before
    the shuffle, and the joins leave a large neighbourhood to skew splitting.
    The rounds grow with the logarithm of the longest path.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    now = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = state(now)
    while True:
        new = stash(_small_star(_large_star(now)), "edges")
        drop(now)
        now, before = new, seen
        seen = state(now)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
