"""Queries of the life of decisions: a log of changes made from line items, and the consolidation of orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import status as S
from threadloom.operators import dedup, intake, lifecycle
from threadloom.plans.base import DECISIONS, RELATIONS, decisions, read, relations, sql_list

_KINDS = ["CREATE", "UPDATE", "STATUS_CHANGE", "UPDATE", "OBJECTION", "STATUS_CHANGE", "DEPRECATE", "REVERT", "GUESS"]
_MOMENT = datetime(1997, 6, 1)


def changes(spark, sf_dir):
    """A change for each line of an order: the first creates, a part of them fails."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_shipdate").alias("ts"))
    k, i, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p")
    kind = F.when(i == 1, F.when(k % 10 == 0, "UPDATE").otherwise("CREATE")).otherwise(F.element_at(F.array(*[F.lit(x) for x in _KINDS[1:]]), (p % 8 + 1).cast("int")))
    return l.select(
        F.concat(F.lit("d"), k.cast("string")).alias("sid"),
        i.cast("long").alias("seq"),
        "ts",
        kind.alias("kind"),
        F.when(p % 3 == 0, F.concat(F.lit("title "), p.cast("string"))).otherwise("").alias("title"),
        F.when(p % 19 == 0, "").otherwise(F.concat(F.lit("summary "), (p % 100).cast("string"))).alias("summary"),
        F.when(p % 4 == 0, F.concat(F.lit("text "), p.cast("string"))).alias("full_text"),
        F.lit("").alias("parent_id"),
        F.when(p % 5 == 0, "major").when(p % 5 == 1, "huge").otherwise("").alias("impact_level"),
        F.when(p % 6 == 0, "").when(p % 23 == 0, "lost").otherwise(F.element_at(F.array(*[F.lit(s) for s in S.STATUSES]), (p % 10 + 1).cast("int"))).alias("status"),
        ((p % 100) / 100.0).alias("confidence"),
        F.when(p % 2 == 0, F.concat(F.lit("u"), (p % 7).cast("string"))).alias("author"),
    )


def change_audit(spark, sf_dir):
    """Why changes have no effect."""
    return lifecycle.audited(changes(spark, sf_dir)).groupBy("kind", "rejected").agg(F.count("*").alias("n"))


def changed_decisions(spark, sf_dir):
    """The decisions after all changes."""
    d = lifecycle.apply_changes(changes(spark, sf_dir))
    return d.select("sid", "title", "summary", "full_text", "impact_level", "status", "confidence", "version", "n_objections", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


def change_history(spark, sf_dir):
    """The ten newest changes of every decision, with their versions."""
    log = changes(spark, sf_dir)
    numbered = lifecycle.versions(log, log.select("sid", F.lit(3).alias("version")).distinct())
    newest = numbered.withColumn("place", F.row_number().over(W.partitionBy("sid").orderBy(F.desc("ts"), "seq")))
    return newest.filter("place <= 10").select("sid", "seq", "kind", F.col("version").cast("long").alias("version"), F.col("place").cast("long").alias("place"))


def first_states(spark, sf_dir):
    """When decisions first had each state."""
    return lifecycle.first_times(changes(spark, sf_dir)).select("sid", "status", F.date_format("first", "yyyy-MM-dd").alias("first"))


def decision_objections(spark, sf_dir):
    """All objections."""
    return lifecycle.objections(changes(spark, sf_dir)).select("oid", "sid", "content", "author")


def decisions_created_by(spark, sf_dir):
    """Decisions as they are, of those that were there by a moment."""
    return lifecycle.created_by(decisions(spark, sf_dir), "created_at", _MOMENT).select("sid", "status")


def merged_tables(spark, sf_dir):
    """A table of decisions with a later one merged into it."""
    d = decisions(spark, sf_dir).select("sid", "title", "status", "confidence", "created_at")
    new = d.filter("confidence > 0.5").withColumn("title", F.when(F.col("confidence") > 0.8, "").otherwise(F.concat(F.col("title"), F.lit(" new")))).withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    new = new.withColumn("sid", F.when(F.col("confidence") > 0.95, F.concat(F.lit("n"), "sid")).otherwise(F.col("sid")))
    return lifecycle.upsert(d, new, "sid").select("sid", "title", "status", "confidence", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def access_scores(spark, sf_dir):
    """Hot scores of decisions from counted accesses, references and relations."""
    d = decisions(spark, sf_dir)
    l = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("sid"), "l_linenumber")
    now = F.lit(datetime(1998, 8, 1))
    hot = lifecycle.access_scores(d, l.filter("l_linenumber > 2"), l.filter("l_linenumber = 2"), relations(spark, sf_dir), now)
    return hot.select("sid", F.round("hot", 6).alias("hot"), F.round(lifecycle.heat_after(F.col("hot"), F.lit(3), F.lit(1)), 6).alias("later"))


def _pairs(spark, sf_dir):
    """Candidate duplicates: neighbours of an order."""
    d = decisions(spark, sf_dir)
    a = d.select("n", F.col("sid").alias("id_a"))
    return a.join(a.select((F.col("n") - 500).alias("n"), F.col("id_a").alias("id_b")), "n").unionByName(a.join(a.select((F.col("n") - 1000).alias("n"), F.col("id_a").alias("id_b")), "n")).select("id_a", "id_b")


def duplicate_decisions(spark, sf_dir):
    """Which of two duplicates stays."""
    return lifecycle.duplicate_pairs(_pairs(spark, sf_dir), decisions(spark, sf_dir), 0.7)


def merged_duplicates(spark, sf_dir):
    """Decisions after their duplicates are merged into them."""
    d = decisions(spark, sf_dir)
    losers = lifecycle.chosen_losers(lifecycle.duplicate_pairs(_pairs(spark, sf_dir), d, 0.7))
    return lifecycle.merge_pairs(losers, d).select("sid", F.md5("full_text").alias("text"), "confidence", "version", "status")


def promoted_decisions(spark, sf_dir):
    """What is pruned and promoted."""
    return lifecycle.promoted(decisions(spark, sf_dir)).filter("action <> 'keep'").select("sid", "action", "status")


def consolidation_report(spark, sf_dir):
    """A whole cycle in numbers."""
    d = decisions(spark, sf_dir)
    verdicts = d.filter("n % 9 = 0").select("sid", F.when(F.col("n") % 2 == 0, "shelve").otherwise("keep").alias("action"))
    return lifecycle.consolidate(d, _pairs(spark, sf_dir), verdicts)[1]


def settled_conflicts(spark, sf_dir):
    """Conflicts settled by a decision of their own."""
    c = relations(spark, sf_dir).filter("type = 'CONFLICTS_WITH'").select(F.concat_ws("+", "src", "dst").alias("sid"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return lifecycle.merged_conflicts(c, decisions(spark, sf_dir))


def kept_conflicts(spark, sf_dir):
    """Conflicts that stay, in both directions."""
    c = relations(spark, sf_dir).filter("type = 'CONFLICTS_WITH'").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return lifecycle.kept_conflicts(c, decisions(spark, sf_dir))


def similar_documents(spark, sf_dir):
    """Documents of a source whose whole texts are alike, as classes of equal bigram sets with how many are in each and how many others they are like."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup.similar_classes(d, "doc_id", "source", "text", 0.7)


def conflicts_settled(spark, sf_dir):
    """All decisions after the conflicts between them have been settled by merging."""
    d = decisions(spark, sf_dir).withColumn("authority", F.when(F.col("n") % 3 == 0, "").otherwise(F.concat(F.lit("a"), (F.col("n") % 5).cast("string"))))
    d = d.withColumn("tags", F.array((F.col("n") % 4).cast("string"), F.lit("x")))
    clash = relations(spark, sf_dir).filter("type = 'CONFLICTS_WITH'").select(F.concat_ws("+", "src", "dst").alias("sid"), F.col("src").alias("source"), F.col("dst").alias("target"))
    out = lifecycle.settle_conflicts(d, clash)
    return out.select("sid", "topic_id", "authority", F.concat_ws(",", F.array_sort("tags")).alias("tags"), "summary", "full_text", "status", "impact_level", "confidence", F.col("version").cast("long").alias("version"))


def taken_in(spark, sf_dir):
    """What becomes of every tenth order as a new decision among the others, with verdicts on some pairs; topics are customers."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    k, text = F.col("k"), lambda c: F.md5(c.cast("string"))
    rows = o.select(
        k, F.concat(F.lit("d"), F.when(k % 70 == 0, k - 1).otherwise(k).cast("string")).alias("sid"), F.lit("p").alias("project"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("topic"),
        F.lit("").alias("title"), F.concat(text(k % 40), F.when(k % 3 == 0, text(k % 11)).otherwise("")).alias("summary"), F.when(k % 4 > 0, text(k % 23)).otherwise("").alias("full_text"),
        F.element_at(F.array(*[F.lit(x) for x in S.STATUSES]), (k % len(S.STATUSES) + 1).cast("int")).alias("status"), F.lit("minor").alias("impact_level"), (k % 100 / 100.0).alias("confidence"), F.array((k % 5).cast("string")).alias("tags"),
    )
    new, old = rows.filter("k % 10 = 0").withColumnRenamed("k", "seq"), rows.filter("k % 10 > 0").withColumnRenamed("k", "ord").withColumn("version", F.lit(1))
    other = old.select(F.col("sid").alias("other"), "topic", F.col("ord").alias("o"))
    pairs = new.select("sid", "topic", "seq").join(other, "topic").filter("(seq + o) % 3 = 0")
    action = F.when((F.col("seq") + F.col("o")) % 4 == 0, "skip").when((F.col("seq") + F.col("o")) % 4 == 1, "update").otherwise("conflict")
    verdicts = pairs.select("sid", "other", action.alias("action"), F.concat(F.lit("see "), "other").alias("info"))
    return intake.take_in(new, old, verdicts).outcomes.select("seq", "sid", "outcome", "target", F.col("wave").cast("long").alias("wave"))


QUERIES = {
    f.__name__: f
    for f in (
        taken_in, conflicts_settled, change_audit, changed_decisions, change_history, first_states, decision_objections, decisions_created_by, merged_tables, access_scores, duplicate_decisions, merged_duplicates,
        promoted_decisions, consolidation_report, settled_conflicts, kept_conflicts, similar_documents,
    )
}

_LOG = f"""l AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS p, min(l_shipdate) AS ts FROM lineitem GROUP BY ALL),
c AS (SELECT 'd' || k AS sid, CAST(i AS BIGINT) AS seq, ts, CASE WHEN i = 1 THEN CASE WHEN k % 10 = 0 THEN 'UPDATE' ELSE 'CREATE' END ELSE {sql_list(_KINDS[1:])}[p % 8 + 1] END AS kind, CASE WHEN p % 3 = 0 THEN 'title ' || p ELSE '' END AS title,
CASE WHEN p % 19 = 0 THEN '' ELSE 'summary ' || (p % 100) END AS summary, CASE WHEN p % 4 = 0 THEN 'text ' || p END AS full_text, CASE WHEN p % 5 = 0 THEN 'major' WHEN p % 5 = 1 THEN 'huge' ELSE '' END AS impact_level,
CASE WHEN p % 6 = 0 THEN '' WHEN p % 23 = 0 THEN 'lost' ELSE {sql_list(S.STATUSES)}[p % 10 + 1] END AS status, CAST((p % 100) / 100.0 AS DOUBLE) AS confidence, CASE WHEN p % 2 = 0 THEN 'u' || (p % 7) END AS author FROM l),
x AS (SELECT *, CASE WHEN kind = 'GUESS' THEN 'unknown kind' WHEN kind = 'CREATE' AND summary = '' THEN 'no summary' WHEN kind IN ('CREATE', 'UPDATE') AND status = 'lost' THEN 'unknown status' WHEN kind = 'STATUS_CHANGE' AND status IN ('', 'lost') THEN 'unknown status' END AS bad FROM c),
y AS (SELECT *, min(CASE WHEN bad IS NULL AND kind = 'CREATE' THEN seq END) OVER (PARTITION BY sid) AS begun FROM x),
z AS (SELECT *, CASE WHEN bad IS NULL AND kind <> 'CREATE' AND (begun IS NULL OR seq < begun) THEN 'unknown sid' ELSE bad END AS rejected FROM y)"""
_PAIRS = """q AS (SELECT a.sid AS a, b.sid AS b FROM d a JOIN d b ON b.n IN (a.n + 500, a.n + 1000)),
g AS (SELECT sid, status, version, confidence, hot_score, CASE status WHEN 'executing' THEN 90 WHEN 'decided' THEN 80 WHEN 'in_discussion' THEN 60 ELSE 50 END + 5e0 * least(version, 10) + 30 * confidence + 0.5 * hot_score AS worth,
list_distinct([lower(summary)[i : i + 1] FOR i IN range(1, length(summary))]) AS g FROM {table} WHERE status IN ('pending', 'pending_confirmation', 'in_discussion', 'decided', 'executing')),
p AS (SELECT least(q.a, q.b) AS a, greatest(q.a, q.b) AS b FROM q),
s AS (SELECT p.a, p.b, x.worth >= y.worth AS first, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 9) AS similarity FROM p JOIN g x ON x.sid = p.a JOIN g y ON y.sid = p.b),
u AS (SELECT CASE WHEN first THEN a ELSE b END AS keep, CASE WHEN first THEN b ELSE a END AS lose, CAST(similarity AS DOUBLE) AS similarity FROM s WHERE similarity >= 0.7)"""
_LOSERS = "m AS (SELECT lose, arg_max(keep, (similarity, keep)) AS keep FROM u GROUP BY lose), o AS (SELECT keep, lose FROM m WHERE keep NOT IN (SELECT lose FROM m))"

ORACLE = {
    "change_audit": f"WITH {_LOG} SELECT kind, rejected, count(*) AS n FROM z GROUP BY ALL",
    "changed_decisions": f"""WITH {_LOG}, v AS (SELECT * FROM z WHERE rejected IS NULL),
w AS (SELECT *, kind IN ('CREATE', 'UPDATE') AS wr, CASE WHEN kind = 'DEPRECATE' THEN 'deprecated' WHEN kind = 'REVERT' THEN 'pending' WHEN kind = 'CREATE' AND status = '' THEN 'pending' WHEN kind IN ('CREATE', 'UPDATE', 'STATUS_CHANGE') THEN status END AS st FROM v)
SELECT sid, arg_max(title, seq) FILTER (WHERE wr AND title <> '') AS title, arg_max(summary, seq) FILTER (WHERE wr AND summary <> '') AS summary, arg_max(full_text, seq) FILTER (WHERE wr AND full_text IS NOT NULL) AS full_text, arg_max(impact_level, seq) FILTER (WHERE wr AND impact_level = 'major') AS impact_level,
arg_max(st, seq) FILTER (WHERE st <> '') AS status, arg_max(confidence, seq) FILTER (WHERE wr) AS confidence, 1 + count(*) FILTER (WHERE kind = 'UPDATE') AS version, count(*) FILTER (WHERE kind = 'OBJECTION') AS n_objections, strftime(min(ts), '%Y-%m-%d') AS created, strftime(max(ts), '%Y-%m-%d') AS updated FROM w GROUP BY sid""",
    "change_history": f"WITH {_LOG}, n AS (SELECT sid, seq, kind, ts, row_number() OVER (PARTITION BY sid ORDER BY seq) + 3 AS version FROM c) SELECT sid, seq, kind, version, row_number() OVER (PARTITION BY sid ORDER BY ts DESC, seq) AS place FROM n QUALIFY place <= 10",
    "first_states": f"WITH {_LOG} SELECT sid, status, strftime(min(ts), '%Y-%m-%d') AS first FROM c WHERE status NOT IN ('', 'lost') GROUP BY ALL",
    "decision_objections": f"WITH {_LOG} SELECT 'obj_' || sid || '_' || seq AS oid, sid, summary AS content, coalesce(author, 'unknown') AS author FROM z WHERE rejected IS NULL AND kind = 'OBJECTION'",
    "decisions_created_by": f"WITH {DECISIONS} SELECT sid, status FROM d WHERE created_at <= TIMESTAMP '1997-06-01'",
    "merged_tables": f"""WITH {DECISIONS}, i AS (SELECT CASE WHEN confidence > 0.95 THEN 'n' || sid ELSE sid END AS sid, CASE WHEN confidence > 0.8 THEN '' ELSE title || ' new' END AS title, status, confidence, created_at + INTERVAL 1 DAY AS created_at FROM d WHERE confidence > 0.5)
SELECT coalesce(d.sid, i.sid) AS sid, coalesce(nullif(i.title, ''), d.title) AS title, coalesce(i.status, d.status) AS status, coalesce(i.confidence, d.confidence) AS confidence, strftime(least(d.created_at, i.created_at), '%Y-%m-%d') AS created FROM d FULL JOIN i ON i.sid = d.sid""",
    "access_scores": f"""WITH {DECISIONS}, {RELATIONS}, a AS (SELECT 'd' || l_orderkey AS sid, count(*) FILTER (WHERE l_linenumber > 2) AS a, count(*) FILTER (WHERE l_linenumber = 2) AS r FROM lineitem GROUP BY 1), k AS (SELECT src AS sid, count(*) AS k FROM r GROUP BY src),
h AS (SELECT d.sid, greatest(0e0, least(1e2, 0.4 * least(1e2, 2e1 * coalesce(a.r, 0)) + 0.2 * least(1e2, 15e0 * coalesce(a.a, 0)) + 0.15 * least(1e2, 25e0 * coalesce(k, 0)) + least(25e0, 25 - 1.5 * greatest(0e0, (epoch_us(TIMESTAMP '1998-08-01') - epoch_us(created_at)) / 864e8)))) AS hot FROM d LEFT JOIN a ON a.sid = d.sid LEFT JOIN k ON k.sid = d.sid)
SELECT sid, round(hot, 6) AS hot, round(least(1e2, hot * pow(95e-2, 3) + 10), 6) AS later FROM h""",
    "duplicate_decisions": f"WITH {DECISIONS}, {_PAIRS.format(table='d')} SELECT keep, lose, similarity FROM u",
    "merged_duplicates": f"""WITH RECURSIVE {DECISIONS}, {_PAIRS.format(table='d')}, {_LOSERS},
n AS (SELECT keep, d.full_text AS t, row_number() OVER (PARTITION BY keep ORDER BY lose) AS i FROM o JOIN d ON d.sid = o.lose),
f AS (SELECT d.sid, d.full_text AS t, CAST(0 AS BIGINT) AS i FROM d WHERE sid IN (SELECT keep FROM o)
UNION ALL SELECT f.sid, CASE WHEN length(n.t) > length(f.t) THEN n.t WHEN contains(f.t, n.t) THEN f.t ELSE f.t || chr(10) || chr(10) || n.t END, f.i + 1 FROM f JOIN n ON n.keep = f.sid AND n.i = f.i + 1),
e AS (SELECT sid, arg_max(t, i) AS t FROM f GROUP BY sid), w AS (SELECT keep, max(d.confidence) AS c, max(d.version) AS v FROM o JOIN d ON d.sid = o.lose GROUP BY keep)
SELECT d.sid, md5(coalesce(e.t, d.full_text)) AS text, greatest(d.confidence, coalesce(w.c, 0)) AS confidence, CASE WHEN w.v IS NULL THEN d.version ELSE greatest(d.version, w.v) + 1 END AS version, CASE WHEN d.sid IN (SELECT lose FROM o) THEN 'superseded' ELSE status END AS status
FROM d LEFT JOIN e ON e.sid = d.sid LEFT JOIN w ON w.keep = d.sid""",
    "promoted_decisions": f"WITH {DECISIONS} SELECT sid, CASE WHEN hot_score < 5 THEN 'prune' ELSE 'promote' END AS action, CASE WHEN hot_score < 5 THEN 'shelved' ELSE 'decided' END AS status FROM d WHERE (status IN ('pending', 'pending_confirmation', 'in_discussion', 'decided', 'executing') AND hot_score < 5 AND confidence < 0.3) OR (status = 'pending' AND hot_score >= 50)",
    "consolidation_report": f"""WITH {DECISIONS}, j AS (SELECT * REPLACE (CASE WHEN n % 18 = 0 AND confidence < 0.8 AND status IN ('pending', 'pending_confirmation', 'in_discussion', 'decided', 'executing') THEN 'shelved' ELSE status END AS status), status AS old FROM d),
{_PAIRS.format(table='j')}, {_LOSERS}, w AS (SELECT keep, max(j.confidence) AS c FROM o JOIN j ON j.sid = o.lose GROUP BY keep),
r AS (SELECT j.sid, hot_score, greatest(confidence, coalesce(w.c, 0)) AS confidence, CASE WHEN j.sid IN (SELECT lose FROM o) THEN 'superseded' ELSE status END AS status FROM j LEFT JOIN w ON w.keep = j.sid),
b AS (SELECT *, status IN ('pending', 'pending_confirmation', 'in_discussion', 'decided', 'executing') AS act FROM r)
SELECT (SELECT count(*) FROM j WHERE status <> old) AS shelved, (SELECT count(*) FROM o) AS merged, count(*) FILTER (WHERE act AND hot_score < 5 AND confidence < 0.3) AS pruned, count(*) FILTER (WHERE act AND NOT (hot_score < 5 AND confidence < 0.3) AND hot_score >= 50 AND status = 'pending') AS promoted, count(*) AS decisions FROM b""",
    "settled_conflicts": f"WITH {DECISIONS}, {RELATIONS} SELECT src || '+' || dst AS sid, s.summary || '; ' || t.summary AS summary, s.full_text || chr(10) || '---' || chr(10) || t.full_text AS full_text, 'decided' AS status, greatest(s.impact_level, t.impact_level) AS impact_level, greatest(s.confidence, t.confidence) AS confidence, dst AS supersedes FROM r JOIN d s ON s.sid = src JOIN d t ON t.sid = dst WHERE type = 'CONFLICTS_WITH'",
    "conflicts_settled": f"""WITH {DECISIONS}, {RELATIONS}, w AS (SELECT *, CASE WHEN n % 3 = 0 THEN '' ELSE 'a' || (n % 5) END AS authority, [CAST(n % 4 AS VARCHAR), 'x'] AS tags FROM d),
m AS (SELECT src || '+' || dst AS sid, src, dst FROM r WHERE type = 'CONFLICTS_WITH' AND src IN (SELECT sid FROM d) AND dst IN (SELECT sid FROM d) GROUP BY ALL)
SELECT sid, topic_id, authority, array_to_string(list_sort(tags), ',') AS tags, summary, full_text, CASE WHEN sid IN (SELECT dst FROM m) THEN 'superseded' ELSE status END AS status, impact_level, confidence, version FROM w
UNION ALL SELECT m.sid, CASE WHEN s.topic_id <> '' THEN s.topic_id ELSE t.topic_id END, CASE WHEN s.authority <> '' THEN s.authority ELSE t.authority END, array_to_string(list_sort(list_distinct(list_concat(s.tags, t.tags))), ','), s.summary || '; ' || t.summary,
s.full_text || chr(10) || '---' || chr(10) || t.full_text, 'decided', greatest(s.impact_level, t.impact_level), greatest(s.confidence, t.confidence), 1 FROM m JOIN w s ON s.sid = m.src JOIN w t ON t.sid = m.dst""",
    "kept_conflicts": f"WITH {DECISIONS}, {RELATIONS}, k AS (SELECT src, dst FROM r WHERE type = 'CONFLICTS_WITH' AND src IN (SELECT sid FROM d) AND dst IN (SELECT sid FROM d)) SELECT src, 'CONFLICTS_WITH' AS type, dst FROM k UNION SELECT dst, 'CONFLICTS_WITH', src FROM k",
    "similar_documents": r"""WITH h AS (SELECT source, doc_id, string_split(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '') AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
g AS (SELECT source, doc_id, list_sort(list_distinct(list_transform(list_zip(t[: -2], t[2 :]), lambda z: z[1] || z[2]))) AS g FROM h WHERE len(t) >= 2),
c AS MATERIALIZED (SELECT source AS block, min(doc_id) AS class_id, count(*) AS n, g FROM g GROUP BY source, g),
u AS (SELECT block, class_id, len(g) AS s, unnest(g) AS x FROM c),
o AS (SELECT a.block, a.class_id AS x, b.class_id AS y, count(*) AS common, any_value(a.s) + any_value(b.s) AS total FROM u a JOIN u b ON a.block = b.block AND a.x = b.x AND a.class_id <> b.class_id GROUP BY ALL),
p AS (SELECT block, x, y FROM o WHERE common >= 0.7 * (total - common)),
k AS (SELECT block, x, count(*) AS l FROM p GROUP BY ALL)
SELECT c.block, c.class_id, c.n, coalesce(l, 0) AS links FROM c LEFT JOIN k ON k.block = c.block AND k.x = c.class_id""",
}
