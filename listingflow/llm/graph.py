"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` for every end of an edge; one value per component.

    ``edges`` has the long columns ``a`` and ``b``. In each round every node joins the
    least of itself and its neighbours, and edges are drawn anew between what is left, until
    none is. Nodes are compared by a hash, so that no order of the input makes
    long chains; what is left shrinks by a constant share per round. A node with very
    many edges costs a partial minimum per task and a split join, never a task of
    its own. Loops and repeated edges change nothing; null ends are ignored. Each round is a
    written table, so a lost executor costs one round at most.
    """
    ends = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("a0"),
                        F.col("b").alias("b0")).where("a0 is not null and b0 is not null")
    names = stored(ends.select(F.col("a").alias("node"), F.col("a0").alias("name"))
                   .union(ends.select("b", "b0")).distinct(), "nodes")
    left = stored(ends.where("a <> b").select("a", "b").distinct(), "edges")
    levels = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parents = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                         .select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents")
        levels.append(parents)
        at_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        at_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = stored(left.join(at_a, "a").join(at_b, "b").where("pa <> pb")
                      .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                      "edges")
    result = names.withColumn("component", F.col("node"))
    for parents in levels:
        step = parents.select(F.col("node").alias("component"), "parent")
        result = result.join(step, "component", "left") \
            .select("node", "name", F.coalesce("parent", "component").alias("component"))
    return result.select(F.col("name").alias("node"), "component")
