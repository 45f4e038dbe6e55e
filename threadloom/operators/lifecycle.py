"""Decisions as a log of changes: folds of it, merges, conflicts and the consolidation of a whole table.

A change has sid, seq (its order), ts, kind (CREATE, UPDATE, STATUS_CHANGE, DEPRECATE, REVERT,
OBJECTION, CONFLICT_MERGE, CONFLICT_KEEP_BOTH) and the fields that it sets; empty ones set nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import status as S
from threadloom.functions.scores import hot_score
from threadloom.operators.likeness import pair_likeness

# Kinds of changes.
KINDS = ["CREATE", "UPDATE", "STATUS_CHANGE", "CONFLICT_MERGE", "CONFLICT_KEEP_BOTH", "OBJECTION", "DEPRECATE", "REVERT"]


def last_set(value: Column, order: Column) -> Column:
    """The last value that isn't null or empty, by aggregation: no sort of a key's whole history."""
    filled = value.isNotNull() & (value.cast("string") != "")
    return F.max_by(value, F.when(filled, order))


def fold(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the last filled value of every field, version (number of changes) and the last change's order."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*[last_set(F.col(f), at).alias(f) for f in fields], F.count("*").alias("version"), F.max(order[0]).alias("updated_at"), F.min(order[0]).alias("created_at"))


def as_of(log: DataFrame, key: str, order: list[str], fields: list[str], moment) -> DataFrame:
    """The state at a moment; keys that began later are absent."""
    return fold(log.filter(F.col(order[0]) <= F.lit(moment)), key, order, fields)


def created_by(rows: DataFrame, created: str, moment) -> DataFrame:
    """Rows that were created by a moment, or at none that is known: the current row, without a history."""
    return rows.filter(F.col(created).isNull() | (F.col(created) <= F.lit(moment)))


def audited(log: DataFrame) -> DataFrame:
    """``log`` with rejected: why a change has no effect, or null.

    Its kind or state isn't known, it has no sid, it creates without a summary, or it changes what no
    valid change before it created.
    """
    status = F.coalesce("status", F.lit(""))
    text = F.coalesce("summary", F.lit(""))
    bad = (
        F.when(F.coalesce("sid", F.lit("")) == "", "no sid")
        .when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "unknown kind")
        .when((F.col("kind") == "CREATE") & (text == ""), "no summary")
        .when(F.col("kind").isin("CREATE", "UPDATE") & (status != "") & ~status.isin(S.STATUSES), "unknown status")
        .when((F.col("kind") == "STATUS_CHANGE") & ~status.isin(S.STATUSES), "unknown status")
    )
    checked = log.withColumn("rejected", bad)
    begun = checked.filter("rejected IS NULL AND kind = 'CREATE'").groupBy("sid").agg(F.min("seq").alias("begun"))
    late = F.col("rejected").isNull() & (F.col("kind") != "CREATE") & (F.col("begun").isNull() | (F.col("seq") < F.col("begun")))
    return checked.join(begun, "sid", "left").withColumn("rejected", F.when(late, "unknown sid").otherwise(F.col("rejected"))).drop("begun")


def apply_changes(log: DataFrame, fields: tuple[str, ...] = ("title", "summary", "full_text", "parent_id", "impact_level")) -> DataFrame:
    """The decisions after all valid changes: fields, status, confidence, version, created_at, updated_at and n_objections.

    CREATE and UPDATE set what they fill in and the confidence, whatever it is; each UPDATE is a new
    version, and a second CREATE begins anew. STATUS_CHANGE sets the state, DEPRECATE and REVERT set
    deprecated and pending. An impact that isn't known sets nothing.
    """
    valid = audited(log).filter("rejected IS NULL").drop("rejected")
    begun = valid.filter("kind = 'CREATE'").groupBy("sid").agg(F.max("seq").alias("begun"))
    valid = valid.join(begun, "sid").filter("seq >= begun")
    kind = F.col("kind")
    writes = kind.isin("CREATE", "UPDATE")
    state = F.when(kind == "DEPRECATE", "deprecated").when(kind == "REVERT", "pending").when((kind == "CREATE") & (F.coalesce("status", F.lit("")) == ""), "pending").when(writes | (kind == "STATUS_CHANGE"), F.col("status"))
    at = F.col("seq")
    if "impact_level" in fields:
        valid = valid.withColumn("impact_level", F.when(F.col("impact_level").isin(S.IMPACTS), F.col("impact_level")))
    return valid.groupBy("sid").agg(
        *[last_set(F.when(writes, F.col(f)), at).alias(f) for f in fields],
        last_set(state, at).alias("status"),
        F.max_by("confidence", F.when(writes, at)).alias("confidence"),
        (1 + F.count_if(kind == "UPDATE")).alias("version"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count_if(kind == "OBJECTION").alias("n_objections"),
    )


def first_times(log: DataFrame) -> DataFrame:
    """(sid, status, first): when a decision first had each state; later returns to it don't count."""
    return log.filter(F.col("status").isin(S.STATUSES)).groupBy("sid", "status").agg(F.min("ts").alias("first"))


def versions(log: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``log`` with version: numbered by sid in order, on from the highest version of ``existing`` (sid, version)."""
    from pyspark.sql import Window as W

    own = F.row_number().over(W.partitionBy("sid").orderBy("seq"))
    if existing is None:
        return log.withColumn("version", own)
    top = existing.groupBy("sid").agg(F.max("version").alias("top"))
    return log.join(top, "sid", "left").withColumn("version", own + F.coalesce("top", F.lit(0))).drop("top")


def upsert(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``rows`` and ``incoming`` merged by key: filled new values win, but created_at stays the earliest."""
    fields = [c for c in rows.columns if c not in (key, "created_at")]
    old, new = rows.alias("o"), incoming.alias("i")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"i.{key}"), "full")
    pick = lambda c: F.coalesce(F.when(F.col(f"i.{c}").cast("string") != "", F.col(f"i.{c}")), F.col(f"o.{c}")).alias(c)
    out = [F.coalesce(F.col(f"o.{key}"), F.col(f"i.{key}")).alias(key), *[pick(c) for c in fields]]
    if "created_at" in rows.columns:
        out.append(F.least("o.created_at", "i.created_at").alias("created_at"))
    return joined.select(*out)


def access_scores(decisions: DataFrame, accesses: DataFrame, references: DataFrame, relations: DataFrame, now) -> DataFrame:
    """(sid, hot): the hot score from counts of accesses (sid), references (sid) and relations (src), at a moment."""
    n = lambda df, c, name: df.groupBy(F.col(c).alias("sid")).agg(F.count("*").alias(name))
    d = decisions.select("sid", "created_at").join(n(accesses, "sid", "a"), "sid", "left").join(n(references, "sid", "r"), "sid", "left").join(n(relations, "src", "k"), "sid", "left")
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.select("sid", hot_score(zero("r"), zero("a"), zero("k"), F.coalesce(days, F.lit(0.0))).alias("hot"))


def heat_after(heat: Column, scans: Column, pushes: Column) -> Column:
    """Heat after some scans, each of which takes a twentieth, and then pushes, each of which adds ten up to 100."""
    return F.least(F.lit(100.0), heat * F.pow(F.lit(0.95), scans) + 10.0 * pushes)


def merge_pairs(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """What becomes of decisions when each loser of ``pairs`` (keep, lose) goes into its keeper: columns of ``decisions`` with full_text, confidence, version and status set.

    Losers' texts come in the order of their sids: one that is longer than the keeper's so far replaces it,
    one that is held in it changes nothing, any other is appended. The keeper's confidence is the
    highest and its version one above the highest. Losers are superseded.
    """
    d = decisions.select("sid", "full_text", "confidence", "version", "status")
    lost = pairs.join(d.select(F.col("sid").alias("lose"), F.col("full_text").alias("lt"), F.col("confidence").alias("lc"), F.col("version").alias("lv")), "lose")
    by_keeper = lost.groupBy(F.col("keep").alias("sid")).agg(F.array_sort(F.collect_list(F.struct("lose", F.coalesce("lt", F.lit("")).alias("t")))).alias("lt"), F.max("lc").alias("lc"), F.max("lv").alias("lv"))

    def take(a: Column, x: Column) -> Column:
        return F.when(F.length(x["t"]) > F.length(a), x["t"]).when(F.contains(a, x["t"]), a).otherwise(F.concat(a, F.lit("\n\n"), x["t"]))

    kept = d.join(by_keeper, "sid", "left").join(pairs.select(F.col("lose").alias("sid"), F.lit(True).alias("gone")).distinct(), "sid", "left")
    text = F.coalesce("full_text", F.lit(""))
    return kept.select(
        "sid",
        F.when(F.col("lt").isNull(), F.col("full_text")).otherwise(F.aggregate(F.coalesce("lt", F.array().cast("array<struct<lose:string,t:string>>")), text, take)).alias("full_text"),
        F.greatest("confidence", "lc").alias("confidence"),
        F.when(F.col("lv").isNull(), F.col("version")).otherwise(F.greatest("version", "lv") + 1).alias("version"),
        F.when(F.col("gone"), "superseded").otherwise(F.col("status")).alias("status"),
    )


def merged_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(sid, summary, full_text, status, impact_level, confidence, supersedes) for conflicts (sid, source, target) that are settled by one decision."""
    side = lambda c, p: decisions.select(F.col("sid").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in ("summary", "full_text", "impact_level", "confidence")])
    both = conflicts.join(side("source", "s"), "source").join(side("target", "t"), "target")
    return both.select("sid", F.concat_ws("; ", "s_summary", "t_summary").alias("summary"), F.concat_ws("\n---\n", "s_full_text", "t_full_text").alias("full_text"), F.lit("decided").alias("status"), F.greatest("s_impact_level", "t_impact_level").alias("impact_level"), F.greatest("s_confidence", "t_confidence").alias("confidence"), F.col("target").alias("supersedes"))


def settle_conflicts(decisions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``decisions`` after conflicts (sid, source, target) are settled: for each a new decided one ``sid``, and the target superseded.

    A merged decision has both summaries and texts, joined, the higher impact (by name) and
    confidence, version 1, and of the fields topic_id, project, authority, assignee and parent_id, as far as there
    are, the source's unless it is empty, of tags both; ``created_at`` is the source's. Other columns
    are null. Conflicts of which a side is unknown, or without a sid, settle nothing; of several of one
    sid the first by source and target counts, and one whose sid is known overwrites that decision.
    Null texts count as empty.
    """
    of_sid = conflicts.filter("coalesce(sid, '') <> ''").groupBy("sid").agg(F.min(F.struct("source", "target")).alias("c")).select(F.col("sid").alias("new_sid"), "c.*")
    side = lambda key, name: decisions.select(F.col("sid").alias(key), F.struct(*[c for c in decisions.columns if c != "sid"]).alias(name))
    both = of_sid.join(side("source", "s"), "source").join(side("target", "t"), "target")
    text = lambda c: F.coalesce(c, F.lit(""))
    pick = lambda c: F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("")), F.col(f"t.{c}"))
    put = {
        "sid": F.col("new_sid"),
        "summary": F.concat(text(F.col("s.summary")), F.lit("; "), text(F.col("t.summary"))),
        "full_text": F.concat(text(F.col("s.full_text")), F.lit("\n---\n"), text(F.col("t.full_text"))),
        "status": F.lit("decided"),
        "impact_level": F.greatest("s.impact_level", "t.impact_level"),
        "confidence": F.greatest("s.confidence", "t.confidence"),
    }
    if "version" in decisions.columns:
        put["version"] = F.lit(1)
    if "created_at" in decisions.columns:
        put["created_at"] = F.col("s.created_at")
    if "tags" in decisions.columns:
        none = F.array().cast("array<string>")
        put["tags"] = F.array_sort(F.array_union(F.coalesce("s.tags", none), F.coalesce("t.tags", none)))
    put |= {c: pick(c) for c in ("topic_id", "project", "authority", "assignee", "parent_id") if c in decisions.columns}
    kinds = {f.name: f.dataType for f in decisions.schema}
    made = both.select(*[put.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in decisions.columns])
    gone = both.select(F.col("target").alias("sid"), F.lit(True).alias("_gone")).distinct()
    rest = decisions.join(made.select("sid"), "sid", "left_anti").join(gone, "sid", "left")
    rest = rest.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status")))
    return rest.select(*decisions.columns).unionByName(made)


def kept_conflicts(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(src, type, dst): both directions of conflicts (source, target) between decisions that exist."""
    known = decisions.select("sid")
    real = conflicts.join(known.select(F.col("sid").alias("source")), "source", "left_semi").join(known.select(F.col("sid").alias("target")), "target", "left_semi")
    edges = F.explode(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"))))
    return real.select(edges.alias("e")).select("e.src", F.lit("CONFLICTS_WITH").alias("type"), "e.dst").distinct()


def objections(log: DataFrame) -> DataFrame:
    """(oid, sid, content, author, ts) of every objection, its id from its decision and place."""
    rows = audited(log).filter("rejected IS NULL AND kind = 'OBJECTION'")
    return rows.select(F.concat_ws("_", F.lit("obj"), "sid", F.col("seq").cast("string")).alias("oid"), "sid", F.coalesce("summary", F.lit("")).alias("content"), F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("unknown")).alias("author"), "ts")


def duplicate_pairs(pairs: DataFrame, decisions: DataFrame, least: float = 0.7) -> DataFrame:
    """(keep, lose, similarity) of candidate pairs (id_a, id_b) of active decisions that are alike enough: the worthier stays, the smaller sid among equals."""
    side = lambda c, p: decisions.filter(S.is_active(F.col("status"))).select(F.col("sid").alias(c), F.col("summary").alias(f"{p}_summary"), S.decision_score(F.col("status"), F.col("version"), F.col("confidence"), F.col("hot_score")).alias(f"{p}_worth"))
    both = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct().join(side("a", "a"), "a").join(side("b", "b"), "b")
    both = both.withColumn("similarity", F.round(pair_likeness(F.col("a_summary"), F.col("b_summary")), 9)).filter(F.col("similarity") >= least)
    first = F.col("a_worth") >= F.col("b_worth")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("lose"), "similarity")


def promoted(decisions: DataFrame) -> DataFrame:
    """``decisions`` with action: active ones that are cold and unsure are shelved, pending ones that are warm are decided."""
    active = S.is_active(F.col("status"))
    action = F.when(active & (F.col("hot_score") < 5) & (F.col("confidence") < 0.3), "prune").when(active & (F.col("hot_score") >= 50) & (F.col("status") == "pending"), "promote").otherwise("keep")
    return decisions.withColumn("action", action).withColumn("status", F.when(F.col("action") == "prune", "shelved").when(F.col("action") == "promote", "decided").otherwise(F.col("status")))


def shelved_by(decisions: DataFrame, verdicts: DataFrame, sure: float = 0.8) -> DataFrame:
    """``decisions`` where a judge's verdicts (sid, action) shelve active ones of a confidence under ``sure``."""
    bad = verdicts.filter("action = 'shelve'").select("sid", F.lit(True).alias("bad")).distinct()
    hit = F.col("bad") & S.is_active(F.col("status")) & (F.col("confidence") < sure)
    return decisions.join(bad, "sid", "left").withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "shelved").otherwise(F.col("status"))).drop("bad")


def chosen_losers(duplicates: DataFrame) -> DataFrame:
    """``duplicates`` (keep, lose, similarity) of which each decision loses once, to the most similar keeper, and no keeper loses itself."""
    best = duplicates.groupBy("lose").agg(F.max_by("keep", F.struct("similarity", "keep")).alias("keep"))
    return best.join(best.select(F.col("lose").alias("keep")), "keep", "left_anti").select("keep", "lose")


def consolidate(decisions: DataFrame, pairs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The decisions after one cycle (shelve, merge duplicates, prune, promote) and a report of one row."""
    from threadloom.sources.scratch import written

    judged = written(shelved_by(decisions, verdicts))
    losers = written(chosen_losers(duplicate_pairs(pairs, judged)))
    merged = written(promoted(merge_pairs(losers, judged).join(judged.select("sid", "hot_score"), "sid")))
    n = lambda test, name: F.count_if(test).alias(name)
    shelved = judged.join(decisions.select("sid", F.col("status").alias("before")), "sid").agg(n(F.col("status") != F.col("before"), "shelved"))
    report = shelved.crossJoin(losers.agg(F.count("*").alias("merged"))).crossJoin(merged.agg(n(F.col("action") == "prune", "pruned"), n(F.col("action") == "promote", "promoted"), F.count("*").alias("decisions")))  # rows of one row
    return merged, report
