"""Connected components of a graph of longs, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    edges: columns a and b. Each round hooks every root to the smallest root next to it,
    follows these pointers twice and keeps only edges between different roots, so every
    root but local minima goes and the graph shrinks by half at least. Both sides of each
    join stay distributed; the driver only asks whether an edge is left.
    """
    rest = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
    labels = checkpointed(ends.withColumn("component", F.col("node")))
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        for _ in range(2):
            step = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
            hook = hook.join(step, "to").select("a", F.col("further").alias("to"))
        hook = checkpointed(hook)
        to_a, to_b = hook.select("a", F.col("to").alias("pa")), hook.select(F.col("a").alias("b"), F.col("to").alias("pb"))
        at = hook.select(F.col("a").alias("component"), "to")
        labels = checkpointed(
            labels.join(at, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        )
        moved = rest.join(to_a, "a").join(to_b, "b").where("pa != pb")
        rest = checkpointed(
            moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
    return labels
