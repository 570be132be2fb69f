"""Connected components by contraction: every round the ends of a link give way to their smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewise.llm.common import settled


def contracted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The edges (a, b) between the parents (node, parent) of their ends, each once, without loops."""
    left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
    right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
    ends = edges.join(left, "a").select("b", "pa").join(right, "b").where("pa <> pb")
    return ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b) with a <> b; label is the smallest node that can be reached.

    A round gives each node its smallest neighbour (or itself) as parent and goes
    on with the links between parents, of which there are fewer every round. The
    labels are then read back from the last round to the first. Nodes and links
    stay in the shared folder; the driver sees only whether links are left.
    """
    edges = settled(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while True:
        low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        own = edges.select(F.col("a").alias("node"), F.col("a").alias("parent")).distinct()
        rounds.append(settled(low.union(own).groupBy("node").agg(F.min("parent").alias("parent"))))
        edges = settled(contracted(edges, rounds[-1]))
        if edges.isEmpty():
            break
    labels = rounds.pop().withColumnRenamed("parent", "label")
    for parents in reversed(rounds):
        roots = labels.select(F.col("node").alias("parent"), F.col("label").alias("root"))
        labels = settled(parents.join(roots, "parent", "left").select("node", F.coalesce("root", "parent").alias("label")))
    return labels
