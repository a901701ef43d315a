"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the smallest node that is connected to it.

    Alternates large-star and small-star steps: each node links its larger,
    then its smaller neighbours to the smallest one, until nothing moves; how
    many rounds that takes grows with the logarithm of the longest path.  Every
    step is one grouping; edges are written to the shared folder in between.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        # large star: neighbours above a node are linked to the least around it
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "least").where("x <> least").select(F.col("x").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
