"""Queries over the trees and the graph of decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import graph
from threadloom.plans.base import ACTIVE, DECISIONS, RELATIONS, decisions, relations


def tree_children(spark, sf_dir):
    """The direct children of every decision."""
    return graph.children(decisions(spark, sf_dir), "sid", "parent_id").select("parent", "n", F.array_join("children", ",").alias("children"))


def tree_depth(spark, sf_dir):
    """The chain of parents of every decision and its length."""
    return graph.paths(decisions(spark, sf_dir), "sid", "parent_id").select("node", F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"))


def tree_ancestors(spark, sf_dir):
    """The ancestors of every decision, from the root."""
    return graph.ancestors(decisions(spark, sf_dir), "sid", "parent_id").select("node", F.col("place").cast("long").alias("place"), "ancestor")


def tree_roots(spark, sf_dir):
    """A project's active decisions without a parent."""
    return graph.active_roots(decisions(spark, sf_dir), "p1").select("sid", "status")


def tree_descendants(spark, sf_dir):
    """All below three decisions, by depth."""
    edges = graph.parent_edges(decisions(spark, sf_dir), "sid", "parent_id")
    start = spark.createDataFrame([("d1",), ("d2",), ("d9",)], "node string")
    return graph.reachable(edges, start, 8).select("root", "node", F.col("depth").cast("long").alias("depth"))


def tree_preorder(spark, sf_dir):
    """All decisions, parents before children."""
    return graph.preorder(decisions(spark, sf_dir), "sid", "parent_id").select("node", F.col("place").cast("long").alias("place"))


def tree_json(spark, sf_dir):
    """Every tree of decisions as nested JSON."""
    return graph.subtrees(decisions(spark, sf_dir), "sid", "parent_id", "status")


def decision_neighbours(spark, sf_dir):
    """The nearest 500 within three undirected relations of one decision."""
    edges = relations(spark, sf_dir).select("src", "dst")
    start = spark.createDataFrame([("d2",)], "node string")
    return graph.nearest_nodes(edges, start, 3).select("node", F.col("depth").cast("long").alias("depth"))


def decision_story(spark, sf_dir):
    """Decisions within five relations of one that refine, replace or depend, in order of time."""
    edges = relations(spark, sf_dir).filter("type IN ('REFINES', 'SUPERSEDES', 'DEPENDS_ON')").select("src", "dst")
    start = spark.createDataFrame([("d2",)], "node string")
    found = graph.neighbourhood(edges, start, 5).select(F.col("node").alias("sid")).distinct()
    return decisions(spark, sf_dir).join(found, "sid").select("sid", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def decision_hyperedges(spark, sf_dir):
    """Relations as hyperedges, by kind."""
    e = graph.hyperedges(relations(spark, sf_dir))
    return e.groupBy("type", "directed").agg(F.count("*").alias("n"), F.sum(F.size("participants")).alias("participants"), F.min("edge").alias("first"))


def decision_co_participants(spark, sf_dir):
    """How many others every decision shares a relation with."""
    e = graph.hyperedges(relations(spark, sf_dir))
    return graph.co_participants(e.select("edge", F.explode("participants").alias("p")).select("edge", "p.node"))


QUERIES = {f.__name__: f for f in (tree_children, tree_depth, tree_ancestors, tree_roots, tree_descendants, tree_preorder, tree_json, decision_neighbours, decision_story, decision_hyperedges, decision_co_participants)}

_UP = f"""WITH RECURSIVE {DECISIONS}, e AS (SELECT parent_id AS src, sid AS dst FROM d WHERE parent_id <> '' AND parent_id <> sid),
c AS (SELECT d.sid AS node, [d.sid] AS path, d.sid AS root FROM d WHERE sid NOT IN (SELECT dst FROM e JOIN d x ON x.sid = e.src)
UNION ALL SELECT e.dst, list_append(c.path, e.dst), c.root FROM c JOIN e ON e.src = c.node)"""
_REACH = """u AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
w AS (SELECT 'd2' AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM w JOIN u ON u.src = w.node WHERE depth < {hops}),
m AS (SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node)"""

def _json_sql(levels: int = 8) -> str:
    """The trees from the deepest level up."""
    steps = [f"""t{k} AS (SELECT node, up, '{{"id":"' || node || '","label":"' || status || '","children":[' || coalesce((SELECT string_agg(x.tree, ',' ORDER BY x.node) FROM t{k + 1} x WHERE x.up = n.node), '') || ']}}' AS tree FROM n WHERE depth = {k})""" for k in range(levels - 1, -1, -1)]
    return _UP + f""", n AS (SELECT node, len(path) - 1 AS depth, path[-2] AS up, status FROM c JOIN d ON d.sid = c.node), t{levels} AS (SELECT '' AS node, '' AS up, '' AS tree WHERE false), {", ".join(steps)} SELECT node, tree FROM t0"""


ORACLE = {
    "tree_json": _json_sql(),
    "tree_children": f"WITH {DECISIONS} SELECT parent_id AS parent, count(*) AS n, string_agg(sid, ',' ORDER BY sid) AS children FROM d WHERE parent_id <> '' AND parent_id <> sid GROUP BY parent_id",
    "tree_depth": _UP + " SELECT node, array_to_string(path, '/') AS path, CAST(len(path) - 1 AS BIGINT) AS depth FROM c",
    "tree_ancestors": _UP + " SELECT node, CAST(i - 1 AS BIGINT) AS place, path[i] AS ancestor FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM c WHERE len(path) > 1)",
    "tree_roots": f"WITH {DECISIONS} SELECT sid, status FROM d WHERE parent_id = '' AND project = 'p1' AND {ACTIVE}",
    "tree_descendants": f"""WITH RECURSIVE {DECISIONS}, e AS (SELECT parent_id AS src, sid AS dst FROM d WHERE parent_id <> '' AND parent_id <> sid),
w AS (SELECT x AS root, x AS node, CAST(0 AS BIGINT) AS depth FROM unnest(['d1', 'd2', 'd9']) t(x) UNION ALL SELECT root, dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 8) SELECT root, node, depth FROM w""",
    "tree_preorder": _UP + " SELECT node, row_number() OVER (ORDER BY path) - 1 AS place FROM c",
    "decision_neighbours": f"WITH RECURSIVE {RELATIONS}, " + _REACH.format(edges="r", hops=3) + " SELECT node, depth FROM m WHERE depth > 0 ORDER BY depth, node LIMIT 500",
    "decision_story": f"WITH RECURSIVE {DECISIONS}, {RELATIONS}, k AS (SELECT src, dst FROM r WHERE type IN ('REFINES', 'SUPERSEDES', 'DEPENDS_ON')), " + _REACH.format(edges="k", hops=5) + " SELECT sid, status, strftime(created_at, '%Y-%m-%d') AS day FROM d JOIN m ON m.node = d.sid",
    "decision_hyperedges": f"WITH {RELATIONS} SELECT type, type NOT IN ('CONFLICTS_WITH', 'RELATES_TO') AS directed, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS participants, min(left(sha256(type || '|' || src || '|' || dst), 16)) AS first FROM r GROUP BY type",
    "decision_co_participants": f"""WITH {RELATIONS}, m AS (SELECT DISTINCT type || src || '|' || dst AS edge, unnest([src, dst]) AS node FROM r),
p AS (SELECT DISTINCT a.node, b.node AS other FROM m a JOIN m b ON a.edge = b.edge AND a.node <> b.node)
SELECT m.node, count(DISTINCT edge) AS n_edges, coalesce(any_value(o), 0) AS n_others FROM m LEFT JOIN (SELECT node, count(*) AS o FROM p GROUP BY node) q ON q.node = m.node GROUP BY m.node""",
}
