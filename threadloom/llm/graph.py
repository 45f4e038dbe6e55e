"""Connected components of a link table, by repeated contraction in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the smallest node that is reachable.

    Every node moves to its first neighbour and links move along, until no link is left between
    different nodes. First means smallest in the first round, which settles stars, and by a new
    hash in each later one, so that paths shrink by a constant factor whatever their order: the
    rounds grow with the logarithm of the longest path. Each round is a minimum by node and a
    join with it, in checkpointed tables; only whether links are left comes to the driver.
    """
    edges = checkpoint(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, round_ = None, 0
    while edges.limit(1).count():
        place = (lambda c: F.col(c)) if not round_ else (lambda c: F.xxhash64(F.col(c), F.lit(round_)))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        # a struct, so that equal places are told apart by the node
        first = F.min(F.struct(place("b").alias("p"), F.col("b").alias("node")))
        moves = both.groupBy("a").agg(first.alias("first")).select(F.col("a").alias("node"), F.least("first", F.struct(place("a").alias("p"), F.col("a").alias("node")))["node"].alias("to"))
        moves = checkpoint(moves)
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:
            step = moves.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = checkpoint(labels)
        a, b = moves.select(F.col("node").alias("a"), F.col("to").alias("ta")), moves.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").filter("ta <> tb")
        edges = checkpoint(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        round_ += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if round_ == 1:  # all moved to their component's smallest node
        return labels
    least = checkpoint(labels.groupBy("component").agg(F.min("node").alias("least")))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
