"""Sessions, lifecycle, hierarchy and rollup queries over events and the star schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from threadloom.functions.scores import heat, hot_score
from threadloom.operators import aggregates, graph, lifecycle, windows
from threadloom.streaming.sessions import stream_sessions


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gap_sessions(spark, sf_dir):
    """Events of each user in sessions parted by half an hour, with the gap before as a bucket."""
    e = windows.gap_sessions(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"], 1800)
    return e.select("event_id", "user_id", F.col("session").cast("long").alias("session"), windows.gap_bucket(F.col("gap")).alias("bucket"))


def session_windows(spark, sf_dir):
    """The sessions themselves, by the operator that streams use."""
    s = stream_sessions(_read(spark, sf_dir, "events"), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("most"))


def last_events(spark, sf_dir):
    """The last five events of each user."""
    return windows.keep_last(_read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", "event_type")


_MIDDLE = datetime(2024, 1, 15)


def user_state(spark, sf_dir):
    """Each user's state as a fold of its events."""
    s = lifecycle.fold(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])
    return s.select("user_id", "event_type", "value", "version")


def user_state_as_of(spark, sf_dir):
    """The same in the middle of the month."""
    s = lifecycle.as_of(_read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"], _MIDDLE)
    return s.select("user_id", "event_type", "version")


def hot_users(spark, sf_dir):
    """Hot score and heat of every user from counts of its events."""
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"), F.max("ts").alias("last"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.col("last").cast("date"))
    score = F.round(hot_score(F.col("n") % 5, F.col("n") % 7, F.col("types"), days), 6)
    return e.select("user_id", score.alias("hot"), heat(score).alias("heat"))


def order_statistics(spark, sf_dir):
    """Counts by status, by priority and in all."""
    return _read(spark, sf_dir, "orders").groupingSets([("o_orderstatus",), ("o_orderpriority",), ()], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers")).select("o_orderstatus", "o_orderpriority", "n", "customers")


def region_descendants(spark, sf_dir):
    """All nodes below each region of region - nation - customer, by depth."""
    nation, customer = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    edges = nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    edges = edges.union(customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    start = _read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.reachable(edges, start, 3).groupBy("root", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


def part_neighbourhood(spark, sf_dir):
    """Parts and suppliers within two undirected hops of part 1."""
    edges = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    start = spark.createDataFrame([("p1",)], "node string")
    return graph.neighbourhood(edges, start, 2).select("node", F.col("depth").cast("long").alias("depth"))


def newest_order(spark, sf_dir):
    """The last order of each customer."""
    return aggregates.keep_newest(_read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


QUERIES = {f.__name__: f for f in (gap_sessions, session_windows, last_events, user_state, user_state_as_of, hot_users, order_statistics, region_descendants, part_neighbourhood, newest_order)}

_GAPS = "SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events"
_LAST = "arg_max({c}, (epoch_us(ts)::HUGEINT * 10000000000 + event_id)) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '')"

ORACLE = {
    "gap_sessions": f"""
SELECT event_id, user_id, CAST(sum(CASE WHEN gap >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session,
CASE WHEN gap IS NULL THEN 'first' WHEN gap < 0 THEN 'negative' WHEN gap < 60 THEN 'minute' WHEN gap < 3600 THEN 'hour' WHEN gap < 86400 THEN 'day' ELSE 'longer' END AS bucket FROM ({_GAPS})""",
    "session_windows": f"""
WITH s AS (SELECT user_id, sum(CASE WHEN gap >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM ({_GAPS})),
n AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS most FROM n GROUP BY user_id""",
    "last_events": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5",
    "user_state": f"SELECT user_id, {_LAST.format(c='event_type')} AS event_type, {_LAST.format(c='value')} AS value, count(*) AS version FROM events GROUP BY user_id",
    "user_state_as_of": f"SELECT user_id, {_LAST.format(c='event_type')} AS event_type, count(*) AS version FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id",
    "hot_users": """
WITH e AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS days FROM events GROUP BY user_id),
s AS (SELECT user_id, round(CAST(greatest(0, least(100, 0.4 * least(100, 20 * (n % 5)) + 0.2 * least(100, 15 * (n % 7)) + 0.15 * least(100, 25 * types) + least(25, 25 - 1.5 * greatest(days, 0)))) AS DOUBLE), 6) AS hot FROM e)
SELECT user_id, hot, CASE WHEN hot >= 80 THEN 'hot' WHEN hot >= 50 THEN 'warm' WHEN hot >= 20 THEN 'cool' ELSE 'cold' END AS heat FROM s""",
    "order_statistics": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "region_descendants": """
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
d AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, CAST(0 AS BIGINT) AS depth FROM region UNION ALL SELECT root, dst, depth + 1 FROM d JOIN e ON src = node)
SELECT root, depth, count(*) AS n FROM d GROUP BY ALL""",
    "part_neighbourhood": """
WITH e AS (SELECT DISTINCT 'p' || l_partkey AS p, 's' || l_suppkey AS s FROM lineitem),
a AS (SELECT s FROM e WHERE p = 'p1')
SELECT 'p1' AS node, CAST(0 AS BIGINT) AS depth UNION SELECT s, 1 FROM a UNION SELECT p, 2 FROM e JOIN a USING (s) WHERE p <> 'p1'""",
    "newest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
}
