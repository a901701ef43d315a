"""Graph operators over an edge table (source, target)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_out, fan_in, instability): distinct neighbours each way; instability = out / (out + in)."""
    out = edges.groupBy(F.col("source").alias("node")).agg(F.countDistinct("target").alias("fan_out"))
    into = edges.groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("fan_in"))
    both = out.join(into, "node", "full_outer").fillna(0, ["fan_out", "fan_in"])
    return both.withColumn("instability", F.col("fan_out") / (F.col("fan_out") + F.col("fan_in")))


def reachable(spark, edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(start, node, steps): nodes that each start reaches and the fewest edges needed.

    The frontier of new nodes is joined to the edges until no node is new.  New
    nodes are cut off with a checkpoint each round where a checkpoint folder is
    set.  If ``most_steps`` is given, more steps are an error, never a shorter result.
    """
    edges = edges.select("source", "target").distinct()
    frontier = starts.select(F.col("node").alias("start"), "node")
    seen = None
    for step in count(1):
        found = frontier.join(edges, frontier["node"] == edges["source"]).select("start", F.col("target").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        found = found.withColumn("steps", F.lit(step))
        found = found.checkpoint() if spark.sparkContext.getCheckpointDir() else found.persist()
        if found.isEmpty():
            break
        if most_steps is not None and step > most_steps:
            raise RuntimeError(f"nodes are more than {most_steps} steps away")
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("start", "node")
        if step % 5 == 0 and spark.sparkContext.getCheckpointDir():
            seen = seen.checkpoint()
    return seen if seen is not None else frontier.withColumn("steps", F.lit(0)).limit(0)


def weak_components(spark, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component; more than ``rounds`` rounds, if given, are an error."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    label = both.groupBy(F.col("source").alias("node")).agg(F.least(F.min("target"), F.first("source")).alias("component"))
    for i in count():
        if rounds is not None and i >= rounds:
            raise RuntimeError(f"components are not settled after {rounds} rounds")
        near = both.join(label.select(F.col("node").alias("target"), "component"), "target").groupBy(F.col("source").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node").select("node", F.least("component", "near").alias("new"), "component")
        # a label points at a node whose own label may be smaller already
        jump = new.select(F.col("node").alias("new"), F.col("new").alias("jumped"))
        new = new.join(jump, "new").select("node", F.least("new", "jumped").alias("component"), F.col("component").alias("old")).persist()
        changed = not new.where("component <> old").isEmpty()
        label = new.select("node", "component")
        if spark.sparkContext.getCheckpointDir():
            label = label.checkpoint()
        if not changed:
            break
    return label


def circular_edges(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target reaches their source again, given (start, node) of the closure."""
    back = closure.select(F.col("start").alias("target"), F.col("node").alias("source"))
    return edges.join(back, ["source", "target"], "left_semi")


def cluster_metrics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, nodes, internal, external, cohesion, coupling) of disjoint clusters (cluster, node); a single node has cohesion 1."""
    s, t = members.select(F.col("cluster").alias("cs"), F.col("node").alias("source")), members.select(F.col("cluster").alias("ct"), F.col("node").alias("target"))
    e = edges.select("source", "target").join(s, "source").join(t, "target")
    sides = e.select(F.explode(F.when(F.col("cs") == F.col("ct"), F.array(F.struct(F.col("cs").alias("cluster"), F.lit(1).alias("inside")))).otherwise(F.array(F.struct(F.col("cs").alias("cluster"), F.lit(0).alias("inside")), F.struct(F.col("ct").alias("cluster"), F.lit(0).alias("inside"))))).alias("x")).select("x.*")
    counts = sides.groupBy("cluster").agg(F.sum("inside").alias("internal"), F.sum(1 - F.col("inside")).alias("external"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("nodes"))
    every = members.agg(F.count("*").alias("every"))
    out = sizes.join(counts, "cluster", "left").fillna(0, ["internal", "external"]).crossJoin(F.broadcast(every))
    n = F.col("nodes")
    return out.select("cluster", "nodes", "internal", "external", F.coalesce(F.try_divide("internal", n * (n - 1) / 2), F.lit(1.0)).alias("cohesion"), F.coalesce(F.try_divide("external", n * (F.col("every") - n)), F.lit(0.0)).alias("coupling"))
