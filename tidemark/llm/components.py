"""Connected components of a table of links, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, store


def components(links: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node in ``links (a, b)``; ``comp`` is the smallest node reachable.

    Each round links every node to the smallest neighbour of its neighbours (large and small stars), which
    shortens paths at least by half, so the number of rounds grows with the logarithm of the longest path.
    Rounds go on until nothing changes.
    No node gathers its neighbours: only minima and distinct pairs are taken.
    """
    edges = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of a node go to its smallest neighbour or itself
        large = edges.select(F.col("b").alias("a"), F.col("a").alias("x")).join(low, "a").select(F.col("x").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = store(small, "edges")
        done = new.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(new, ["a", "b"], "left_anti").isEmpty()
        drop_stored(edges)
        edges = new
        if done:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
