"""Queries of the store of decisions: filters, listings, statistics, relations and checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from threadloom.functions import status as S
from threadloom.operators import store
from threadloom.plans.base import ACTIVE, DECISIONS, RELATIONS, TOPIC, decisions, read, relations

_SINCE = datetime(1997, 1, 1)


def decision_topic(spark, sf_dir):
    """The active decisions of one topic of a project."""
    return store.by_topic(decisions(spark, sf_dir), "p1", "general").select("sid", "status", "summary")


def decision_timeline(spark, sf_dir):
    """Decided ones of a topic since 1997, newest first."""
    return store.timeline(decisions(spark, sf_dir), "1-URGENT", "decided", _SINCE, 100).select("sid", "topic_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def decision_recent(spark, sf_dir):
    """Active decisions since 1997."""
    return store.recent(decisions(spark, sf_dir), _SINCE).select("sid", "status", "topic_id")


def decision_hot(spark, sf_dir):
    """The hottest active decisions."""
    return store.hot(decisions(spark, sf_dir), 90.0, 50).select("sid", "hot_score")


def decision_forgotten(spark, sf_dir):
    """The five coldest active decisions, as reminders."""
    return store.forgotten(decisions(spark, sf_dir), 10.0, 5).select("sid", "hot_score")


def decision_lookup(spark, sf_dir):
    """Some decisions by their key."""
    return store.lookup(decisions(spark, sf_dir), "sid", ["d1", "d7", "d999999999"]).select("sid", "status", "impact_level", "version", "parent_id")


def decision_statistics(spark, sf_dir):
    """Counts by state, by impact and in all."""
    return store.statistics(decisions(spark, sf_dir))


def decision_projects(spark, sf_dir):
    """Decisions and topics by project."""
    return store.project_counts(decisions(spark, sf_dir))


def decision_newest(spark, sf_dir):
    """The newest decisions of a topic, whatever their state."""
    return store.newest_first(decisions(spark, sf_dir).filter("topic_id = '5-LOW'"), 30).select("sid", "status")


def decision_topics(spark, sf_dir):
    """The topics of a project."""
    return store.topics(decisions(spark, sf_dir), "p2")


def decision_cross_topic(spark, sf_dir):
    """The decisions of a topic and of those it is related to."""
    found = store.cross_topic(decisions(spark, sf_dir), relations(spark, sf_dir), "p0", "general")
    return found.groupBy("topic_id").agg(F.count("*").alias("n"), F.min("n").alias("first"))


def decision_relevant(spark, sf_dir):
    """Decisions that hold one of two phrases."""
    return store.relevant(decisions(spark, sf_dir), ["OPTION 77 ", "customer 12"]).select("sid")


def decision_related(spark, sf_dir):
    """What every decision is related to."""
    return store.related(decisions(spark, sf_dir), relations(spark, sf_dir)).select("src", "type", "sid", "status")


def decision_conflicts(spark, sf_dir):
    """All conflicts, with what the states say of them."""
    return store.conflicts(decisions(spark, sf_dir), relations(spark, sf_dir))


def decision_conflicts_of(spark, sf_dir):
    """Conflicts that existing decisions have with those of one project."""
    d = decisions(spark, sf_dir)
    return store.conflicts_of(d, relations(spark, sf_dir), d.filter("project = 'p1'"))


def decision_equal_summaries(spark, sf_dir):
    """Summaries that several active decisions have."""
    return store.equal_summaries(decisions(spark, sf_dir))


def decision_dedup_context(spark, sf_dir):
    """What a judge of duplicates sees."""
    return store.dedup_context(decisions(spark, sf_dir))


def decision_rollup(spark, sf_dir):
    """Topics with their decisions and relations."""
    return store.topic_rollup(decisions(spark, sf_dir), relations(spark, sf_dir)).select("topic", "n", F.size("sids").cast("long").alias("n_sids"), F.md5(F.array_join("sids", ",")).alias("sids"), "n_relations")


def decision_output(spark, sf_dir):
    """Decisions as they are shown."""
    return store.for_output(decisions(spark, sf_dir))


def decision_tolerant(spark, sf_dir):
    """Loose records made of suppliers, read as decisions."""
    s = read(spark, sf_dir, "supplier")
    raw = s.select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("topic"), F.col("s_name").alias("decision"), F.when(F.col("s_suppkey") % 2 == 0, "decided").otherwise("no such state").alias("status"), (F.col("s_suppkey") % 9).cast("string").alias("version"), F.when(F.col("s_suppkey") % 4 == 0, "0.25").otherwise("much").alias("confidence"))
    return store.tolerant(raw).select("sid", "topic_id", "summary", "full_text", "status", "impact_level", "version", "confidence")


def decision_errors(spark, sf_dir):
    """How many decisions fail which checks."""
    bad = store.errors(decisions(spark, sf_dir).withColumn("confidence", F.col("confidence") * 1.2), store.decision_checks())
    return bad.filter(F.size("errors") > 0).groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


def decision_keys(spark, sf_dir):
    """Titles that several decisions have, as a check of unique keys."""
    return store.repeated_keys(decisions(spark, sf_dir), "title")


def decision_dangling(spark, sf_dir):
    """Relations to decisions that don't exist."""
    return store.dangling(relations(spark, sf_dir), "dst", decisions(spark, sf_dir), "sid").select("src", "type", "dst")


def ontology_errors(spark, sf_dir):
    """Parts as entities, checked against attribute definitions."""
    p = read(spark, sf_dir, "part")
    entities = p.select("p_name", F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "Product").otherwise("Service").alias("type"), F.create_map(F.lit("brand"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(""), F.lit("size"), F.when(F.col("p_size") < 25, "small").otherwise("large")).alias("attributes"))
    definitions = spark.createDataFrame([("Product", "brand", True, None), ("Product", "size", False, ["small", "medium"]), ("Service", "owner", True, None)], "type string, attribute string, required boolean, allowed array<string>")
    return store.attribute_errors(entities, definitions)


def ontology_relations(spark, sf_dir):
    """Which relations between projects rules allow."""
    d = decisions(spark, sf_dir)
    side = lambda c: d.select(F.col("sid").alias(c), F.col("project").alias(f"{c}_type"))
    edges = relations(spark, sf_dir).join(side("src"), "src").join(side("dst"), "dst")
    rules = spark.createDataFrame([("p0", "*", "REFINES"), ("*", "p1", "DEPENDS_ON"), ("p2", "p2", "SUPERSEDES")], "src_type string, dst_type string, type string")
    return store.legal_relations(edges, rules).select("src", "dst", "type")


def decision_markdown(spark, sf_dir):
    """Decisions as Markdown with a head."""
    return store.front_matter(decisions(spark, sf_dir), ["sid", "topic_id", "status", "version"], "full_text")


def decision_sync(spark, sf_dir):
    """What would bring an older list of the decisions up to date."""
    d = decisions(spark, sf_dir)
    old = d.filter("n % 10 <> 3").withColumn("status", F.when(F.col("n") % 7 == 0, F.lit("pending")).otherwise(F.col("status"))).union(d.filter("n % 10 = 4").withColumn("sid", F.concat(F.lit("old"), F.col("sid"))))
    return store.changes_of(d, old, "sid", ["status", "title"]).groupBy("action").agg(F.count("*").alias("n"))


def message_union(spark, sf_dir):
    """Messages that are known with those that come in, each once."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    new = e.filter("event_id % 3 <> 0").union(e.filter("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 10_000_000))
    return store.ordered_union(e.filter("event_id % 2 = 0"), new.union(new), "event_id")


def last_changes(spark, sf_dir):
    """The last event of each user and day."""
    e = read(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.date_format("ts", "dd")).alias("path"), "event_id", "ts", "event_type")
    return store.last_event(e, "path", ["ts", "event_id"]).select("path", "event_id", "event_type")


def status_pairs(spark, sf_dir):
    """Scores and labels of pairs of states."""
    d = decisions(spark, sf_dir).filter("n < 400")
    pairs = d.select(F.col("status").alias("a"), "n", "version", "confidence", "hot_score", "title").withColumn("b", F.element_at(F.array(*[F.lit(s) for s in S.STATUSES]), (F.floor(F.col("n") / 10) % 10 + 1).cast("int")))
    return pairs.select("n", S.conflict_status(F.col("a"), F.col("b")).alias("conflict"), F.round(S.decision_score(F.col("a"), F.col("version"), F.col("confidence"), F.col("hot_score")), 6).alias("score"), S.is_decided(F.col("a")).alias("decided"), S.is_inactive(F.col("b")).alias("inactive"), F.round(S.percent_change(F.col("hot_score"), F.col("version").cast("double")), 6).alias("change"), S.next_version(F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(".4"))).alias("next"), S.relation_label(F.col("title")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        decision_topic, decision_timeline, decision_recent, decision_hot, decision_forgotten, decision_lookup, decision_statistics, decision_projects, decision_newest, decision_topics,
        decision_cross_topic, decision_relevant, decision_related, decision_conflicts, decision_conflicts_of, decision_equal_summaries, decision_dedup_context, decision_rollup,
        decision_output, decision_tolerant, decision_errors, decision_keys, decision_dangling, ontology_errors, ontology_relations, decision_markdown, decision_sync, message_union,
        last_changes, status_pairs,
    )
}

_WITH, _BOTH = f"WITH {DECISIONS} ", f"WITH {DECISIONS}, {RELATIONS} "
_CONFLICT = "CASE WHEN {a} = 'completed' OR {b} = 'completed' THEN 'resolved' WHEN {a} = 'superseded' OR {b} = 'superseded' THEN 'superseded' WHEN {a} = 'deprecated' OR {b} = 'deprecated' THEN 'deprecated' WHEN {a} = 'shelved' OR {b} = 'shelved' THEN 'shelved' WHEN {a} = 'decided' AND {b} = 'decided' THEN 'conflict_active' ELSE 'unknown' END"
_WORTH = "CASE a WHEN 'completed' THEN 100 WHEN 'executing' THEN 90 WHEN 'decided' THEN 80 WHEN 'in_discussion' THEN 60 WHEN 'superseded' THEN 20 WHEN 'deprecated' THEN 10 WHEN 'shelved' THEN 5 ELSE 50 END"

ORACLE = {
    "decision_topic": _WITH + f"SELECT sid, status, summary FROM d WHERE project = 'p1' AND {TOPIC} = 'general' AND {ACTIVE}",
    "decision_timeline": _WITH + "SELECT sid, topic_id, status, strftime(created_at, '%Y-%m-%d') AS day FROM d WHERE topic_id = '1-URGENT' AND status = 'decided' AND created_at >= TIMESTAMP '1997-01-01' ORDER BY created_at DESC, sid LIMIT 100",
    "decision_recent": _WITH + f"SELECT sid, status, topic_id FROM d WHERE {ACTIVE} AND created_at > TIMESTAMP '1997-01-01'",
    "decision_hot": _WITH + f"SELECT sid, hot_score FROM d WHERE {ACTIVE} AND hot_score >= 90 ORDER BY hot_score DESC, sid LIMIT 50",
    "decision_forgotten": _WITH + f"SELECT sid, hot_score FROM d WHERE {ACTIVE} AND hot_score <= 10 ORDER BY hot_score, sid LIMIT 5",
    "decision_lookup": _WITH + "SELECT sid, status, impact_level, version, parent_id FROM d WHERE sid IN ('d1', 'd7', 'd999999999')",
    "decision_statistics": _WITH + f"SELECT status, impact_level, count(*) AS n, count(DISTINCT {TOPIC}) AS topics, count(*) FILTER (WHERE {ACTIVE}) AS n_active FROM d GROUP BY GROUPING SETS ((status), (impact_level), ())",
    "decision_projects": _WITH + f"SELECT project, count(*) AS n, count(DISTINCT {TOPIC}) AS topics FROM d GROUP BY project",
    "decision_newest": _WITH + "SELECT sid, status FROM d WHERE topic_id = '5-LOW' ORDER BY created_at DESC NULLS LAST, sid LIMIT 30",
    "decision_topics": _WITH + f"SELECT DISTINCT {TOPIC} AS topic FROM d WHERE project = 'p2'",
    "decision_cross_topic": _BOTH
    + f""", o AS (SELECT *, {TOPIC} AS topic FROM d WHERE project = 'p0'),
t AS (SELECT 'general' AS topic UNION SELECT b.topic FROM o a JOIN r ON r.src = a.sid JOIN o b ON b.sid = r.dst WHERE a.topic = 'general')
SELECT topic_id, count(*) AS n, min(n) AS first FROM o WHERE topic IN (SELECT topic FROM t) GROUP BY topic_id""",
    "decision_relevant": _WITH + "SELECT sid FROM d WHERE contains(lower(summary), 'option 77 ') OR contains(lower(full_text), 'option 77 ') OR contains(lower(summary), 'customer 12') OR contains(lower(full_text), 'customer 12')",
    "decision_related": _BOTH + "SELECT DISTINCT r.src, r.type, d.sid, d.status FROM r JOIN d ON d.sid = r.dst",
    "decision_conflicts": _BOTH + f"SELECT DISTINCT src, dst, t.status AS target_status, {_CONFLICT.format(a='s.status', b='t.status')} AS conflict FROM r LEFT JOIN d t ON t.sid = r.dst LEFT JOIN d s ON s.sid = r.src WHERE type = 'CONFLICTS_WITH'",
    "decision_conflicts_of": _BOTH + "SELECT DISTINCT 'conflict_' || src || '_' || dst AS conflict_id, src AS decision_a, dst AS decision_b, 'Conflict between ''' || o.summary || ''' and ''' || w.summary || '''' AS description FROM r JOIN d o ON o.sid = src JOIN d w ON w.sid = dst WHERE type = 'CONFLICTS_WITH' AND w.project = 'p1'",
    "decision_equal_summaries": _WITH + f"SELECT lower(trim(summary)) AS summary, count(*) AS n, min(sid) AS first FROM d WHERE {ACTIVE} GROUP BY lower(trim(summary)) HAVING count(*) > 1",
    "decision_dedup_context": _WITH + f"SELECT sid, title, summary FROM d WHERE {ACTIVE} ORDER BY created_at DESC, sid LIMIT 50",
    "decision_rollup": _BOTH + f"SELECT {TOPIC} AS topic, count(*) AS n, count(*) AS n_sids, md5(string_agg(sid, ',' ORDER BY sid)) AS sids, CAST(sum(coalesce(e, 0)) AS BIGINT) AS n_relations FROM d LEFT JOIN (SELECT src, count(*) AS e FROM (SELECT DISTINCT * FROM r) GROUP BY src) ON src = sid GROUP BY {TOPIC}",
    "decision_output": _WITH + f"SELECT sid, {TOPIC} AS topic_id, title, summary, status, impact_level, 'v' || version || '.0' AS version, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM d",
    "decision_tolerant": "SELECT 'x' || s_suppkey AS sid, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'general' END AS topic_id, s_name AS summary, s_name AS full_text, CASE WHEN s_suppkey % 2 = 0 THEN 'decided' ELSE 'pending' END AS status, 'minor' AS impact_level, 'v' || (s_suppkey % 9) || '.0' AS version, CASE WHEN s_suppkey % 4 = 0 THEN 0.25 ELSE 0.8 END::DOUBLE AS confidence FROM supplier",
    "decision_errors": _WITH + "SELECT concat_ws(',', CASE WHEN topic_id = '' THEN 'topic' END, CASE WHEN confidence * 1.2 > 1 THEN 'confidence' END) AS errors, count(*) AS n FROM d WHERE topic_id = '' OR confidence * 1.2 > 1 GROUP BY 1",
    "decision_keys": _WITH + "SELECT title, count(*) AS n FROM d GROUP BY title HAVING count(*) > 1",
    "decision_dangling": _BOTH + "SELECT src, type, dst FROM r WHERE dst NOT IN (SELECT sid FROM d)",
    "ontology_errors": """
SELECT CAST(p_partkey AS VARCHAR) AS name, 'missing brand' AS error FROM part WHERE p_partkey % 2 = 0 AND (p_size <= 10 OR p_brand = '')
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'not allowed size' FROM part WHERE p_partkey % 2 = 0 AND p_size >= 25
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'missing owner' FROM part WHERE p_partkey % 2 = 1""",
    "ontology_relations": _BOTH + "SELECT src, dst, type FROM r JOIN d a ON a.sid = src JOIN d b ON b.sid = dst WHERE (type = 'REFINES' AND a.project = 'p0') OR (type = 'DEPENDS_ON' AND b.project = 'p1') OR (type = 'SUPERSEDES' AND a.project = 'p2' AND b.project = 'p2')",
    "decision_markdown": _WITH + "SELECT sid, '---' || chr(10) || 'sid: ' || sid || chr(10) || 'topic_id: ' || topic_id || chr(10) || 'status: ' || status || chr(10) || 'version: ' || version || chr(10) || '---' || chr(10) || full_text AS text FROM d",
    "decision_sync": _WITH
    + """, o AS (SELECT sid, CASE WHEN n % 7 = 0 THEN 'pending' ELSE status END AS status, title FROM d WHERE n % 10 <> 3 UNION ALL SELECT 'old' || sid, status, title FROM d WHERE n % 10 = 4)
SELECT CASE WHEN o.sid IS NULL THEN 'create' WHEN d.sid IS NULL THEN 'delete' WHEN o.status <> d.status OR o.title <> d.title THEN 'update' ELSE 'keep' END AS action, count(*) AS n FROM d FULL JOIN o ON o.sid = d.sid GROUP BY 1""",
    "message_union": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_id % 3 <> 0 AND event_id % 2 <> 0 UNION ALL SELECT event_id + 10000000, user_id, event_type FROM events WHERE event_id % 5 = 0",
    "last_changes": "SELECT user_id || '/' || strftime(ts, '%d') AS path, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%d') ORDER BY ts DESC, event_id DESC) = 1",
    "status_pairs": _WITH
    + f""", p AS (SELECT n, status AS a, ['pending', 'pending_confirmation', 'in_discussion', 'decided', 'executing', 'completed', 'shelved', 'rejected', 'superseded', 'deprecated'][(n // 10) % 10 + 1] AS b, version, confidence, hot_score FROM d WHERE n < 400)
SELECT n, {_CONFLICT.format(a='a', b='b')} AS conflict, CAST(round({_WORTH} + 5 * least(version, 10) + 30 * confidence + 0.5 * hot_score, 6) AS DOUBLE) AS score, a IN ('decided', 'executing', 'completed') AS decided,
b IN ('completed', 'shelved', 'rejected', 'superseded', 'deprecated') AS inactive, CASE WHEN hot_score <> 0 THEN round(100 * (version - hot_score) / hot_score, 6) END AS change, 'v' || version || '.5' AS next, 'RELATES_TO' AS label FROM p""",
}
