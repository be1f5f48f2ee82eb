"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.shared import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); equal labels mean connected.

    Each round every node points to its smallest neighbour, itself included, and edges move to the nodes pointed to, until
    none is left. Ids should be in no order (hashes), so that a chain shrinks by a constant factor each round. Self-loops
    and repeated edges do no harm; an empty table gives an empty one.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = settled(both(edges.select("a", "b").where("a <> b")).distinct())
    labels = None
    while not left.isEmpty():
        to = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        to = settled(to)
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            moved = to.withColumnRenamed("node", "label")
            labels = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = settled(labels)
        left = (
            left.join(to.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .select(F.col("a2").alias("a"), F.col("b2").alias("b"))
        )
        # a node that points to another keeps its own target's onward edge
        onward = to.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").where("to <> next")
        left = settled(both(left.unionByName(onward.select(F.col("to").alias("a"), F.col("next").alias("b"))).where("a <> b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0) if labels is None else labels
