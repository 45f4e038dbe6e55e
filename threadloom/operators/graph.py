"""Hierarchies and neighbourhoods by frontier joins with a depth guard.

Each level is a join of the frontier with the edges, written as a table, so that the plan of a
level doesn't hold those before it; nodes seen before drop out, so cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.status import is_active
from threadloom.sources.scratch import beside, written


def reachable(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes within ``depth`` directed steps of each ``start`` (node), at their least depth."""
    step = written(edges.filter("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct())
    levels = [written(start.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct())]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("root", "node")
        level = levels[-1].join(step, "node").select("root", F.col("to").alias("node"), F.lit(d).alias("depth")).distinct()
        levels.append(written(level.join(seen, ["root", "node"], "left_anti")))
        if not levels[-1].limit(1).count():
            break
    return reduce(DataFrame.unionByName, levels)


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """As ``reachable``, along edges in both directions."""
    return reachable(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), start, hops)


def nearest_nodes(edges: DataFrame, start: DataFrame, hops: int, most: int = 500) -> DataFrame:
    """The first ``most`` nodes within some undirected hops, the nearest first, ties by node."""
    return neighbourhood(edges, start, hops).filter("depth > 0").orderBy("depth", "node", "root").limit(most)


def parent_edges(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(src, dst) from parents to children; a node that names itself or nobody has no parent."""
    return nodes.filter((F.coalesce(F.col(parent).cast("string"), F.lit("")) != "") & ~F.col(parent).eqNullSafe(F.col(key))).select(F.col(parent).alias("src"), F.col(key).alias("dst"))


def roots(nodes: DataFrame, parent: str) -> DataFrame:
    """Nodes without a parent."""
    return nodes.filter(F.coalesce(F.col(parent).cast("string"), F.lit("")) == "")


def active_roots(decisions: DataFrame, project: str) -> DataFrame:
    """A project's active decisions without a parent."""
    return roots(decisions, "parent_id").filter(is_active(F.col("status")) & (F.col("project") == project))


def children(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(parent, n, children): the direct children of every node that has some, in order."""
    found = parent_edges(nodes, key, parent).groupBy(F.col("src").alias("parent"))
    return found.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("dst")).alias("children"))


def paths(nodes: DataFrame, key: str, parent: str, depth: int = 32) -> DataFrame:
    """(node, path, depth, complete): the chain of parents of every node, the root first, the node last.

    By doubling: in each round a chain takes on the chain of its first node, so rounds grow with the
    logarithm of the depth. Chains end where a parent doesn't exist; ``complete`` is false where
    ``depth`` or a cycle ended one. Chains that have ended are set apart, and the others meet only
    the chains of their first nodes: ever fewer nodes, each the first of ever more chains, so these
    are broadcast once they are few (``beside``).
    """
    up = parent_edges(nodes, key, parent)
    known = nodes.select(F.col(key).alias("src")).distinct()
    first = nodes.select(F.col(key).alias("node")).distinct().join(up.join(known, "src", "left_semi").select(F.col("dst").alias("node"), "src"), "node", "left")
    chains = written(first.groupBy("node").agg(F.min("src").alias("top")).select("node", F.array(F.col("node")).alias("path"), "top"))
    ended, open_, steps = [chains.filter("top IS NULL")], chains.filter("top IS NOT NULL"), 0
    while (1 << steps) <= depth and open_.limit(1).count():
        tops = beside(written(open_.select(F.col("top").alias("node")).distinct()))
        above = reduce(DataFrame.unionByName, [*ended, open_]).join(tops, "node", "left_semi").select(F.col("node").alias("top"), F.col("path").alias("above"), F.col("top").alias("next"))
        joined = open_.join(beside(written(above)), "top", "left")
        cycle = F.coalesce(F.arrays_overlap("above", "path"), F.lit(False))
        chains = written(joined.select("node", F.when(F.col("above").isNull() | cycle, F.col("path")).otherwise(F.concat("above", "path")).alias("path"), F.when(cycle, F.col("top")).otherwise(F.col("next")).alias("top")))
        ended.append(chains.filter("top IS NULL"))
        open_ = chains.filter("top IS NOT NULL")
        steps += 1
    chains = reduce(DataFrame.unionByName, [*ended, open_])
    return chains.select("node", "path", (F.size("path") - 1).alias("depth"), F.col("top").isNull().alias("complete"))


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, place, ancestor): from the root, at place 0, down to the parent."""
    chains = paths(nodes, key, parent).filter("depth > 0")
    return chains.select("node", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("place", "ancestor"))


def preorder(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(node, place): parents before children, siblings by key, over the whole forest.

    Chains of keys sort that way; the places come from sums by range partition, not from one task.
    """
    chains = paths(nodes, key, parent).select("node", "path")
    dealt = written(chains.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # a row for each partition
    own = F.row_number().over(W.partitionBy("part").orderBy("path"))
    return dealt.join(F.broadcast(offsets), "part").select("node", (F.col("before") + own - 1).alias("place"))


def subtrees(nodes: DataFrame, key: str, parent: str, label: str, levels: int = 8) -> DataFrame:
    """(node, tree): every node without a parent with what is below it, as nested JSON, ``levels`` deep.

    Built from the deepest level up: each level's children are grouped under their parents.
    """
    chains = paths(nodes, key, parent).filter(F.col("depth") < levels)
    rows = written(chains.join(nodes.select(F.col(key).alias("node"), F.col(label).alias("label")), "node").select("node", "depth", "label", F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent")))
    below, tree = None, None
    for d in range(levels - 1, -1, -1):
        own = rows.filter(F.col("depth") == d)
        kids = F.coalesce(F.col("kids"), F.array().cast("array<string>")) if below is not None else F.array().cast("array<string>")
        own = own.join(below, "node", "left") if below is not None else own
        text = F.concat(F.lit('{"id":'), F.to_json(F.array("node")).substr(F.lit(2), F.length(F.to_json(F.array("node"))) - 2), F.lit(',"label":'), F.to_json(F.array(F.coalesce("label", F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce("label", F.lit(""))))) - 2), F.lit(',"children":['), F.array_join(kids, ","), F.lit("]}"))
        tree = own.select("node", "parent", text.alias("tree"))
        below = written(tree.groupBy(F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "tree"))), lambda x: x["tree"]).alias("kids"))) if d else None
    return tree.select("node", "tree")


def co_participants(members: DataFrame) -> DataFrame:
    """(node, n_edges, n_others): in how many hyperedges (edge, node) a node is, and how many others share one with it."""
    m = members.select("edge", "node").distinct()
    sizes = m.groupBy("node").agg(F.count("*").alias("n_edges"))
    pairs = m.join(m.select("edge", F.col("node").alias("other")), "edge").filter("node <> other").select("node", "other").distinct()
    return sizes.join(pairs.groupBy("node").agg(F.count("*").alias("n_others")), "node", "left").select("node", "n_edges", F.coalesce("n_others", F.lit(0)).alias("n_others"))


def hyperedges(relations: DataFrame) -> DataFrame:
    """(edge, type, directed, participants) from relations (src, type, dst): an edge for each, its id from its content."""
    # Kinds of relations without a direction.
    directed = ~F.col("type").isin("CONFLICTS_WITH", "RELATES_TO")
    role = lambda c, name: F.struct(F.col(c).alias("node"), F.lit(name).alias("role"), F.lit(1.0).alias("weight"))
    return relations.distinct().select(F.sha2(F.concat_ws("|", "type", "src", "dst"), 256).substr(1, 16).alias("edge"), "type", directed.alias("directed"), F.array(role("src", "source"), role("dst", "target")).alias("participants"))
