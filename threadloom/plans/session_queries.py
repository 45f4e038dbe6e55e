"""Queries of episodes, groups and bursts over events, and of topics over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import clustering, retrieval
from threadloom.plans.base import read
from threadloom.streaming import episodes as E
from threadloom.streaming import timed

#: The end of January 2024 in epoch seconds: when timers stop.
UNTIL = 1706745600.0


def _messages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    text = F.concat(F.when(F.col("event_id") % 40 == 0, "By the way ").otherwise(""), F.col("event_type"), F.lit(" number "), (F.col("event_id") % 3).cast("string"))
    rows = e.select(F.col("user_id").alias("chat"), F.col("event_id").alias("id"), "ts", text.alias("text"), F.when(F.col("event_id") % 6 == 0, F.col("event_type")).otherwise("").alias("thread"), (F.col("event_id") % 200).alias("v"))
    return rows.join(v, "v", "left").drop("v")


def episode_assignment(spark, sf_dir):
    """The episode of every event, by time, words and vectors."""
    return E.episodes(_messages(spark, sf_dir), E.Rules(gap=4 * 3600, size=30))


def gap_episodes(spark, sf_dir):
    """The episodes that time alone makes."""
    found = E.episodes(_messages(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<double>")).withColumn("text", F.lit("")), E.Rules(size=1_000_000_000))
    return found.groupBy("chat").agg(F.count_distinct("episode").alias("episodes"), F.count("*").alias("n"))


def discussion_groups(spark, sf_dir):
    """Events in threads and in runs within a day that share a word."""
    g = E.micro_groups(_messages(spark, sf_dir), 86400.0)
    return g.groupBy("chat", "grp").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def quiet_changes(spark, sf_dir):
    """When a user's changes are ready, an hour after the last."""
    return E.debounced(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 hour").select("user_id", F.unix_micros("ready").alias("ready"), "n")


def first_changes(spark, sf_dir):
    """Each user's first event of every burst of a day."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts")
    return E.first_of_bursts(e, "user_id", 86400.0)


def vector_clusters(spark, sf_dir):
    """Clusters of the vectors of each label, on three levels."""
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return clustering.clusters(_blocks(v), 3)


def _blocks(v):
    """Blocks of 500 vectors of a label at most."""
    return v.withColumn("block", F.concat_ws("/", F.col("block").cast("string"), F.floor(F.col("id") / 5000).cast("string")))


def vector_tree(spark, sf_dir):
    """Which cluster holds which."""
    return clustering.containment_tree(vector_clusters(spark, sf_dir))


def topic_hierarchy(spark, sf_dir):
    """All vectors as one tree of topics of four levels; distances are weighted by lengths."""
    v = read(spark, sf_dir, "embeddings").select(F.lit("all").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 7 + 1).alias("length"))
    found = clustering.topic_hierarchy(v, 4)
    return found.select("topic", "level", "cluster", "n", "parent", "children", F.round(F.element_at("centroid", 1), 6).alias("first"))


def suspended_episodes(spark, sf_dir):
    """When episodes of users' events are suspended after four hours without another, and archived a day later, up to the end of January."""
    plain = _messages(spark, sf_dir).withColumn("vector", F.lit(None).cast("array<double>")).withColumn("text", F.lit(""))
    found = timed.timed_episodes(plain, E.Rules(gap=4 * 3600.0, size=1_000_000_000, pool=1_000_000_000), UNTIL).filter("id IS NULL")
    return found.select("chat", "episode", "event", F.round(F.col("at") * 1000).cast("long").alias("at"))


def pooled_episodes(spark, sf_dir):
    """Episodes of users' events by time, words and vectors, with one pool of 20 suspended ones over all users."""
    found = timed.pooled_episodes(_messages(spark, sf_dir), E.Rules(gap=4 * 3600.0, size=30), UNTIL)
    return found.select("chat", "id", "episode", "event", F.round(F.col("at") * 1000).cast("long").alias("at"))


def vector_distances(spark, sf_dir):
    """Weighted distances of the vectors of each label."""
    v = read(spark, sf_dir, "embeddings").select(F.col("label").alias("block"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = clustering.distances(_blocks(v))
    lengths = _blocks(v.withColumn("length", (F.col("id") % 7 + 1).cast("double"))).select("block", "id", "length")
    w = clustering.weighted_distances(pairs, lengths)
    return w.groupBy("block").agg(F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("least"), F.round(F.max("distance"), 6).alias("most"), F.round(F.avg("distance"), 6).alias("mean"))


def topic_assignment(spark, sf_dir):
    """Where vectors go in a tree of the means of labels and of halves of labels."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))
    top = retrieval.centroids(v, "label", "vector").select(F.col("cluster").alias("node"), F.lit(None).cast("long").alias("parent"), "vector")
    low = retrieval.centroids(v.withColumn("half", F.col("label") * 2 + 100 + F.col("id") % 2), "half", "vector").select(F.col("cluster").alias("node"), F.floor((F.col("cluster") - 100) / 2).cast("long").alias("parent"), "vector")
    return clustering.assigned(v, top.unionByName(low), 2, 0.45, 0.3)


QUERIES = {f.__name__: f for f in (episode_assignment, gap_episodes, discussion_groups, quiet_changes, first_changes, vector_clusters, vector_tree, topic_hierarchy, suspended_episodes, pooled_episodes, vector_distances, topic_assignment)}

ORACLE = {
    "suspended_episodes": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 14400000000 THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS s FROM g), e AS (SELECT CAST(user_id AS VARCHAR) AS chat, CAST(s AS BIGINT) AS episode, max(t) / 1e3 + 14400000 AS z FROM s GROUP BY ALL)
SELECT chat, episode, 'suspended:gap' AS "event", CAST(round(z) AS BIGINT) AS "at" FROM e WHERE z <= 1706745600000 UNION ALL SELECT chat, episode, 'archived', CAST(round(z + 86400000) AS BIGINT) FROM e WHERE z + 86400000 <= 1706745600000""",
    "gap_episodes": """WITH g AS (SELECT user_id, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 < 1800 THEN 0 ELSE 1 END AS new FROM events)
SELECT CAST(user_id AS VARCHAR) AS chat, CAST(sum(new) AS BIGINT) AS episodes, count(*) AS n FROM g GROUP BY user_id""",
    "quiet_changes": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, max(t) + 3600000000 AS ready, count(*) AS n FROM s GROUP BY user_id, s""",
    "first_changes": """WITH RECURSIVE e AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, id, t, k FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.id, e.t, e.k FROM w JOIN e ON e.user_id = w.user_id AND e.k = (SELECT min(k) FROM e x WHERE x.user_id = w.user_id AND x.k > w.k AND x.t - w.t >= 86400000000))
SELECT CAST(user_id AS VARCHAR) AS user_id, id FROM w""",
    "vector_distances": """WITH v AS (SELECT CAST(label AS VARCHAR) || '/' || (vec_id // 5000) AS block, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 7 + 1 AS l FROM embeddings),
w AS (SELECT *, least(2e0, greatest(0.5e0, l / avg(l) OVER (PARTITION BY block))) AS w FROM v),
p AS (SELECT a.block, a.w AS x, b.w AS y, greatest(0e0, least(2e0, 1 - list_cosine_similarity(a.v, b.v))) AS d FROM w a JOIN w b ON a.block = b.block AND a.id < b.id),
q AS (SELECT block, d * CASE WHEN x < 1 AND y < 1 THEN 2 - sqrt(x * y) WHEN x > 1 AND y > 1 THEN 1 / sqrt(x * y) ELSE 1 END AS d FROM p)
SELECT block, count(*) AS n, round(min(d), 6) AS least, round(max(d), 6) AS most, round(avg(d), 6) AS mean FROM q GROUP BY block""",
    "topic_assignment": """WITH v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT label AS node, CAST(NULL AS BIGINT) AS parent, i, avg(v[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL UNION ALL SELECT label * 2 + 100 + id % 2, label, i, avg(v[i]) FROM v, range(1, 65) t(i) GROUP BY label, id % 2, i),
c AS (SELECT node, parent, list(x ORDER BY i) AS c FROM n GROUP BY node, parent),
a AS (SELECT id, v, node, round(list_cosine_similarity(v, c), 9) AS s FROM v, c WHERE parent IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, node) = 1),
b AS (SELECT a.id, c.node, round(list_cosine_similarity(v, c), 9) AS s FROM a JOIN c ON c.parent = a.node WHERE a.s >= 0.45 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(v, c), 9) DESC, c.node) = 1)
SELECT a.id, CASE WHEN b.s >= 0.3 THEN b.node WHEN a.s >= 0.3 THEN a.node END AS node, CASE WHEN b.s >= 0.3 THEN b.s WHEN a.s >= 0.3 THEN a.s END AS score FROM a LEFT JOIN b ON b.id = a.id""",
}
