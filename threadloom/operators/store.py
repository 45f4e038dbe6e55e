"""Listings, filters, statistics and checks over tables of decisions and their relations.

A table of decisions has sid, project, topic_id, status, impact_level, title, summary, full_text,
parent_id, hot_score, confidence, version, chat_id and created_at; relations have src, type and dst.
Ties are always settled by sid.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import status as S
from threadloom.functions.text import holds_any
from threadloom.sources.scratch import beside


def active(decisions: DataFrame) -> DataFrame:
    return decisions.filter(S.is_active(F.col("status")))


def topic_of(topic: Column) -> Column:
    """'general' for decisions without a topic."""
    return F.coalesce(F.nullif(topic, F.lit("")), F.lit("general"))


def newest_first(decisions: DataFrame, most: int | None = None) -> DataFrame:
    ordered = decisions.orderBy(F.desc_nulls_last("created_at"), "sid")
    return ordered if most is None else ordered.limit(most)


def by_topic(decisions: DataFrame, project: str, topic: str) -> DataFrame:
    """The active decisions of a topic of a project."""
    return active(decisions).filter((F.col("project") == project) & (topic_of(F.col("topic_id")) == topic))


def timeline(decisions: DataFrame, topic: str | None = None, status: str | None = None, since: datetime | None = None, most: int | None = None) -> DataFrame:
    """Decisions of a topic, a state and a time, newest first; a filter that isn't given takes all."""
    for test in [F.col("topic_id") == topic if topic else None, F.col("status") == status if status else None, F.col("created_at") >= F.lit(since) if since else None]:
        decisions = decisions if test is None else decisions.filter(test)
    return newest_first(decisions, most)


def recent(decisions: DataFrame, since: datetime) -> DataFrame:
    """Active decisions that are newer, newest first."""
    return newest_first(active(decisions).filter(F.col("created_at") > F.lit(since)))


def hot(decisions: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """Active decisions of a hot score of at least ``least``, the hottest first."""
    found = active(decisions).filter(F.col("hot_score") >= least).orderBy(F.desc("hot_score"), "sid")
    return found if most is None else found.limit(most)


def forgotten(decisions: DataFrame, most_score: float, most: int | None = None) -> DataFrame:
    """Active decisions of a hot score of at most ``most_score``, the coldest first: reminders."""
    found = active(decisions).filter(F.col("hot_score") <= most_score).orderBy("hot_score", "sid")
    return found if most is None else found.limit(most)


def lookup(rows: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of these keys."""
    return rows.filter(F.col(key).isin(values))


def statistics(decisions: DataFrame) -> DataFrame:
    """Counts by state, by impact and in all, with the topics and the active decisions of each."""
    return decisions.groupingSets([("status",), ("impact_level",), ()], "status", "impact_level").agg(
        F.count("*").alias("n"), F.countDistinct(topic_of(F.col("topic_id"))).alias("topics"), F.count_if(S.is_active(F.col("status"))).alias("n_active")
    ).select("status", "impact_level", "n", "topics", "n_active")


def project_counts(decisions: DataFrame) -> DataFrame:
    """Decisions and topics of every project."""
    return decisions.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct(topic_of(F.col("topic_id"))).alias("topics"))


def topics(decisions: DataFrame, project: str) -> DataFrame:
    """The topics of a project."""
    return decisions.filter(F.col("project") == project).select(topic_of(F.col("topic_id")).alias("topic")).distinct()


def cross_topic(decisions: DataFrame, relations: DataFrame, project: str, topic: str) -> DataFrame:
    """The decisions of a topic and of the topics that its decisions are related to, active or not.

    Which topics refer to which follows from the relations between their decisions.
    """
    own = decisions.filter(F.col("project") == project).withColumn("topic", topic_of(F.col("topic_id")))
    from_topic = own.filter(F.col("topic") == topic).select(F.col("sid").alias("src"))
    to_topics = relations.join(from_topic, "src", "left_semi").join(own.select(F.col("sid").alias("dst"), F.col("topic")), "dst").select("topic").union(own.sparkSession.createDataFrame([(topic,)], "topic string"))
    return own.join(beside(to_topics.distinct()), "topic", "left_semi").drop("topic")


def relevant(decisions: DataFrame, keywords: list[str]) -> DataFrame:
    """Decisions whose summary or text holds one of the keywords, whatever the case."""
    return decisions.filter(holds_any(F.col("summary"), keywords) | holds_any(F.col("full_text"), keywords))


def related(decisions: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, type, and the columns of the target) of every relation whose target exists; the same relation counts once."""
    return relations.select("src", "type", "dst").distinct().join(decisions, F.col("dst") == F.col("sid")).drop("dst")


def conflicts(decisions: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, target_status, conflict) of every relation of conflict, whether the target exists or not."""
    edges = relations.filter("type = 'CONFLICTS_WITH'").select("src", "dst").distinct()
    side = lambda c, name: decisions.select(F.col("sid").alias(c), F.col("status").alias(name))
    found = edges.join(side("dst", "target_status"), "dst", "left").join(side("src", "own_status"), "src", "left")
    return found.select("src", "dst", "target_status", S.conflict_status(F.col("own_status"), F.col("target_status")).alias("conflict"))


def conflicts_of(decisions: DataFrame, relations: DataFrame, new: DataFrame) -> DataFrame:
    """(conflict_id, decision_a, decision_b, description) for new decisions (sid, summary) that existing ones name in a conflict."""
    edges = relations.filter("type = 'CONFLICTS_WITH'").select("src", "dst").distinct()
    theirs = decisions.select(F.col("sid").alias("src"), F.col("summary").alias("other"))
    found = edges.join(new.select(F.col("sid").alias("dst"), F.col("summary").alias("own")), "dst").join(theirs, "src")
    return found.select(F.concat_ws("_", F.lit("conflict"), "src", "dst").alias("conflict_id"), F.col("src").alias("decision_a"), F.col("dst").alias("decision_b"), F.format_string("Conflict between '%s' and '%s'", "other", "own").alias("description"))


def equal_summaries(decisions: DataFrame) -> DataFrame:
    """(summary, n, sids) of summaries that several active decisions have, whatever the case."""
    low = F.lower(F.trim("summary"))
    found = active(decisions).filter(low != "").groupBy(low.alias("summary")).agg(F.count("*").alias("n"), F.min("sid").alias("first"))
    return found.filter("n > 1")


def dedup_context(decisions: DataFrame, most: int = 50) -> DataFrame:
    """Title and summary of the newest active decisions, for a judge of duplicates."""
    return newest_first(active(decisions), most).select("sid", "title", "summary")


def topic_rollup(decisions: DataFrame, relations: DataFrame) -> DataFrame:
    """(topic, n, sids, n_relations): a topic's decisions, in order, and the relations that start at them."""
    out = relations.distinct().groupBy(F.col("src").alias("sid")).agg(F.count("*").alias("edges"))
    joined = decisions.join(out, "sid", "left").groupBy(topic_of(F.col("topic_id")).alias("topic"))
    return joined.agg(F.count("*").alias("n"), F.array_sort(F.collect_list("sid")).alias("sids"), F.sum(F.coalesce("edges", F.lit(0))).alias("n_relations"))


def tolerant(raw: DataFrame) -> DataFrame:
    """Decisions from loose records of strings: aliases, defaults, and unknown values of enumerations replaced.

    Columns that a record may have under another name: sid or id, topic_id or topic, content or
    decision, executor or assignee. Those that are missing count as empty.
    """
    have = set(raw.columns)
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(""))
    body = text("content", "decision")
    version = text("version")
    version = F.when(version == "", "v1.0").when(version.rlike(r"^\d+$"), F.concat(F.lit("v"), version, F.lit(".0"))).when(F.startswith(version, F.lit("v")), version).otherwise(F.concat(F.lit("v"), version))
    confidence = F.coalesce(F.expr("try_cast(confidence AS double)"), F.lit(0.8)) if "confidence" in have else F.lit(0.8)
    summary = F.coalesce(F.nullif(text("summary", "title"), F.lit("")), body)
    return raw.select(
        text("sid", "id").alias("sid"),
        topic_of(text("topic_id", "topic")).alias("topic_id"),
        text("title").alias("title"),
        summary.alias("summary"),
        body.alias("full_text"),
        S.known_or(text("status"), S.STATUSES, "pending").alias("status"),
        S.known_or(text("impact_level"), S.IMPACTS, "minor").alias("impact_level"),
        version.alias("version"),
        text("executor", "assignee").alias("assignee"),
        text("parent_id").alias("parent_id"),
        confidence.alias("confidence"),
        F.try_to_timestamp(text("created_at")).alias("created_at"),
    )


def for_output(decisions: DataFrame) -> DataFrame:
    """What is shown of decisions: times as text, empty values for nulls."""
    return decisions.select("sid", topic_of(F.col("topic_id")).alias("topic_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "status", "impact_level", F.format_string("v%d.0", F.col("version").cast("int")).alias("version"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"))


def errors(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows`` with errors: the names of the checks that a row fails, in their order. A check that is null fails."""
    return rows.withColumn("errors", F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]), lambda e: e.isNotNull()))


def decision_checks() -> dict[str, Column]:
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return {"sid": filled("sid"), "topic": filled("topic_id"), "summary": filled("summary"), "status": F.col("status").isin(S.STATUSES), "impact": F.col("impact_level").isin(S.IMPACTS), "confidence": F.col("confidence").between(0, 1)}


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that several rows have."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose filled key no known row has."""
    return rows.filter(F.coalesce(F.col(key), F.lit("")) != "").join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def attribute_errors(entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """(name, error) of entities (name, type, attributes: a map) against definitions (type, attribute, required, allowed: an array or null)."""
    joined = entities.join(F.broadcast(definitions), "type")  # an ontology: a row for each attribute of each type
    value = F.try_element_at("attributes", F.col("attribute"))
    missing = F.col("required") & F.coalesce(value == "", F.lit(True))
    wrong = value.isNotNull() & (value != "") & F.col("allowed").isNotNull() & ~F.array_contains("allowed", value)
    error = F.when(missing, F.concat(F.lit("missing "), F.col("attribute"))).when(wrong, F.concat(F.lit("not allowed "), F.col("attribute")))
    return joined.select("name", error.alias("error")).filter("error IS NOT NULL")


def legal_relations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges (src_type, dst_type, type, ...) that a rule (src_type, dst_type, type) allows; '*' in a rule stands for any type."""
    r = F.broadcast(rules.select(*[F.col(c).alias(f"r_{c}") for c in ("src_type", "dst_type", "type")]))  # an ontology
    fits = lambda c: (F.col(f"r_{c}") == "*") | (F.col(f"r_{c}") == F.col(c))
    return edges.join(r, (F.col("r_type") == F.col("type")) & fits("src_type") & fits("dst_type"), "left_semi")


def front_matter(decisions: DataFrame, fields: list[str], body: str) -> DataFrame:
    """(sid, text): decisions as Markdown with a head of ``key: value`` lines."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields]
    return decisions.select("sid", F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.coalesce(F.col(body), F.lit(""))).alias("text"))


def changes_of(rows: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, action): create, update, delete or keep, to bring ``known`` to the state of ``rows``."""
    digest = F.xxhash64(*fields)
    both = rows.select(key, digest.alias("new")).join(known.select(key, digest.alias("old")), key, "full")
    return both.select(key, F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep").alias("action"))


def ordered_union(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows, and those incoming rows whose key none of them has, each such key once (its first by all columns)."""
    new = incoming.join(existing.select(key).distinct(), key, "left_anti")
    first = new.groupBy(key).agg(F.min(F.struct(*[c for c in existing.columns if c != key])).alias("f")).select(key, "f.*")
    return existing.unionByName(first.select(*existing.columns))


def last_event(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("e")).select("e.*")


def rendered_groups(found: DataFrame, query: str) -> DataFrame:
    """(line, text) of decisions found (topic, rank, status, summary) for people: a head, then topics with their decisions."""
    lines = found.groupBy("topic").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "status", "summary"))).alias("d"))
    body = F.concat(F.array(F.format_string("  Topic: %s (%d matches)", "topic", "n")), F.transform("d", lambda d: F.format_string("    [%s] %s", d["status"], d["summary"])))
    return lines.select("first", F.posexplode(body).alias("place", "text")).select(F.lit(query).alias("query"), "first", "place", "text")
