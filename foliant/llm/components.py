"""Connected components of an edge list, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b).

    Every round a node takes the smallest root among itself and its neighbours and then its
    root's root, so long chains halve. Rounds are tables of ``scratch``, dropped when the next
    one stands; only a count of changes reaches the driver. A hub's edges meet in map-side
    minima, never in one list.
    """
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("root"), F.lit(True).alias("moved")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("to"))
        step = scratch.table(step, "step")
        hop = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = step.join(hop, "to", "left").select("node", F.coalesce("further", "to").alias("root"), (F.coalesce("further", "to") != F.col("root")).alias("moved"))
        new = scratch.table(jumped, "labels")
        scratch.drop(step, labels)
        labels = new
        if not new.where("moved").limit(1).count():
            scratch.drop(both)
            return new.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
