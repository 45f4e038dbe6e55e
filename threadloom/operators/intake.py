"""New decisions into a table of decisions, each of which sees what those before it have changed.

The rule is one row at a time. Rows that can't meet are independent, though: what a row does
hangs on the decisions it is like and on those of its sid, and these change only by rows that
are like them too. So rows are applied in waves: a row is ready when no earlier open row
shares a decision or a likeness with it, all ready rows of a wave go at once, and the result
is that of one at a time. The waves are as many as the longest chain of rows that meet; each
goes over the rows that are still open and the decisions that these may meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import status as S
from threadloom.operators.likeness import bigram_sets, like_between
from threadloom.sources.scratch import written

#: Columns of new rows: seq (their order), then what a decision has. Existing decisions have ord (their order) and version besides.
FIELDS = ["sid", "project", "topic", "title", "summary", "full_text", "status", "impact_level", "confidence", "tags"]
#: Fixed value: what stands before a judge's supplement to a text.
SUPPLEMENT = "\n\n[补充]\n"


@dataclass
class Intake:
    """``decisions`` afterwards, with ord and version; ``outcomes`` (seq, sid, outcome, target, wave); ``conflicts`` (sid, other)."""

    decisions: DataFrame
    outcomes: DataFrame
    conflicts: DataFrame


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _likenesses(new: DataFrame, sources: DataFrame, near: float) -> DataFrame:
    """(seq, src, a, b, c): of each new row and each source of texts of its topic, how alike summaries are as they stand (a) and cleared (b), and texts cleared (c); null under ``near``."""
    measures = [("a", "summary", True), ("b", "summary", False), ("c", "full_text", False)]
    found = []
    for name, text, as_is in measures:
        one, other = bigram_sets(new, "seq", "topic", text, as_is), bigram_sets(sources, "src", "topic", text, as_is)
        null = [F.lit(None).cast("double").alias(n) for n, _, _ in measures]
        own = like_between(one, other, near).select(F.col("id").alias("seq"), F.col("other").alias("src"), F.col("block").alias("topic"), *[F.col("similarity").alias(n) if n == name else x for (n, _, _), x in zip(measures, null, strict=True)])
        found.append(own)
    rows = reduce(DataFrame.unionByName, found)
    return rows.filter("src <> seq").groupBy("seq", "src", "topic").agg(*[F.max(n).alias(n) for n, _, _ in measures])


def _met(open_: DataFrame, state: DataFrame, like: DataFrame, near: float) -> DataFrame:
    """(seq, e, ord, a, seen, active, project): the decisions of its topic that an open row is like, as they are now."""
    own = state.select(F.col("sid").alias("e"), "ord", "topic", "s_src", "f_src", S.is_active(F.col("status")).alias("active"), F.col("project").alias("e_project"))
    by_summary = like.filter("a IS NOT NULL OR b IS NOT NULL").join(own.withColumnRenamed("s_src", "src"), ["topic", "src"]).select("seq", "e", "ord", "active", "e_project", "a", "b", F.lit(None).cast("double").alias("c"))
    by_text = like.filter("c IS NOT NULL").join(own.withColumnRenamed("f_src", "src"), ["topic", "src"]).select("seq", "e", "ord", "active", "e_project", F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b"), "c")
    met = by_summary.unionByName(by_text).join(open_.select("seq"), "seq", "left_semi")
    return met.groupBy("seq", "e", "ord", "active", "e_project").agg(F.max("a").alias("a"), F.coalesce(F.max("b"), F.max("c")).isNotNull().alias("seen"))


def take_in(new: DataFrame, existing: DataFrame, verdicts: DataFrame, near: float = 0.15, sure: float = 0.65) -> Intake:
    """New decisions (seq and FIELDS) taken into ``existing`` (ord, version and FIELDS) in the order of seq.

    A row whose sid is known updates that decision. Else the first active decision of its
    project and topic whose summary is ``near`` it in bigrams counts as similar: from ``sure`` on
    the row goes into it, below that as a judge's verdict says. Then the verdicts on all other
    decisions of its topic whose summary or text is near count, in order, up to one that drops
    the row ('skip') or sends it elsewhere ('update'); 'conflict' sets both against each other and
    goes on. A row that nothing drops or sends anywhere is a new decision of version 1.

    verdicts: (sid, other, action, info), the judge's word on a new row and a decision; where it
    says nothing, or anything else, the two aren't the same. An update overwrites what the row
    fills in (without a title the summary is one) and adds 1 to the version; one by sid takes the
    row's confidence, one by likeness the higher of both and the tags of both. Project, topic and
    status of a decision stay. A verdict's info is appended to the row's text, unless it is in it;
    likeness is that of texts without it. Conflicts of dropped rows are dropped.

    Rows need a seq and a sid of their own, decisions a sid; without a topic a row is like none.
    Sids of ``existing`` are distinct. Rows of equal seq aren't allowed.
    """
    spark = new.sparkSession
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("confidence", "tags") else F.coalesce(F.col(c), F.lit(0.0) if c == "confidence" else F.array().cast("array<string>")).alias(c) for c in FIELDS]
    rows = written(new.filter("seq IS NOT NULL AND coalesce(sid, '') <> ''").select(F.col("seq").cast("long").alias("seq"), *filled))
    state_all = existing.filter("coalesce(sid, '') <> ''").select(F.col("ord").cast("long").alias("ord"), F.col("version").cast("long").alias("version"), *filled)
    topics = rows.filter("topic <> ''").select("topic").distinct()
    # sources are named by seq, or by the negative place of a decision among the existing ones
    state_all = written(state_all.withColumn("src", -F.monotonically_increasing_id() - 1).withColumn("s_src", F.col("src")).withColumn("f_src", F.col("src")).withColumn("note", F.lit("")))
    near_by = state_all.join(topics, "topic", "left_semi").select("sid").unionByName(state_all.join(rows.select("sid").distinct(), "sid", "left_semi").select("sid")).distinct()
    apart = state_all.join(near_by, "sid", "left_anti")
    state = state_all.join(near_by, "sid", "left_semi")
    # a row's texts may come to stand in the topic of any decision or row of its sid
    places = rows.select("sid", "topic").unionByName(state.select("sid", "topic")).filter("topic <> ''").distinct()
    own = rows.select("sid", F.col("seq").alias("src"), "summary", "full_text").join(places, "sid").select("src", "topic", "summary", "full_text")
    sources = own.unionByName(state.filter("topic <> ''").select("src", "topic", "summary", "full_text"))
    like = written(_likenesses(rows.filter("topic <> ''"), written(sources), near))
    said = verdicts.filter(F.col("action").isin("skip", "update", "conflict")).groupBy("sid", F.col("other").alias("e")).agg(F.max(F.struct("action", F.coalesce("info", F.lit("")).alias("info"))).alias("v"))
    said = written(said.select("sid", "e", "v.action", "v.info"))
    top = state_all.agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]

    open_, outcomes, conflicts, wave, settled_for = rows, [], [], 0, []
    state = state.drop("src")
    while not open_.isEmpty():
        met = written(_met(open_, state, like, near))
        # what a row waits for: its sid, the decisions it is like and the open rows it is like
        mates = like.select("seq", F.col("src").alias("mate")).filter("mate >= 0").join(open_.select("seq"), "seq", "left_semi").join(open_.select(F.col("seq").alias("mate"), F.col("sid").alias("need")), "mate").select("seq", "need")
        needs = open_.select("seq", F.col("sid").alias("need")).unionByName(met.select("seq", F.col("e").alias("need"))).unionByName(mates).distinct()
        first = needs.groupBy("need").agg(F.min("seq").alias("first"))
        waits = needs.join(first, "need").filter("first < seq").select("seq").distinct()
        ready = written(open_.join(waits, "seq", "left_anti"))

        known = ready.join(state.select("sid"), "sid", "left_semi").select("seq", F.lit("update").alias("how"))
        judged = met.join(ready.select("seq", "sid", "project"), "seq").join(known, "seq", "left_anti").join(said, ["sid", "e"], "left")
        alike = judged.filter((F.col("a") >= near) & F.col("active") & (F.col("project") == F.col("e_project")))
        similar = alike.groupBy("seq").agg(F.min(F.struct("ord", "e", "a", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("info", F.lit("")).alias("info"))).alias("sim"))
        others = judged.join(similar.select("seq", F.col("sim.e").alias("sim_e")), "seq", "left").filter(F.col("seen") & F.col("action").isNotNull() & ~F.col("e").eqNullSafe(F.col("sim_e")))
        listed = others.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("ord", "e", "action", "info"))).alias("rest"))  # the judge's words on one row
        settled = _settled(ready.join(known, "seq", "left").join(similar, "seq", "left").join(listed, "seq", "left"), sure)
        settled = written(settled)
        outcomes.append(settled.select("seq", "sid", "outcome", F.col("target"), F.lit(wave).alias("wave")))
        conflicts.append(settled.filter("outcome <> 'dropped'").select(F.col("target").alias("sid"), F.explode("against").alias("other")))
        open_ = written(open_.join(ready.select("seq"), "seq", "left_anti"))
        # a decision stays in the waves while an open row has its topic or its sid
        topics = open_.filter("topic <> ''").select("topic", F.lit(True).alias("by_topic")).distinct()
        sids = open_.select("sid", F.lit(True).alias("by_sid")).distinct()
        after = _applied(state, settled.filter("outcome <> 'dropped'"), top).join(topics, "topic", "left").join(sids, "sid", "left")
        after = written(after.withColumn("live", F.coalesce("by_topic", "by_sid", F.lit(False))).drop("by_topic", "by_sid"))
        settled_for.append(after.filter("NOT live").drop("live"))
        state = after.filter("live").drop("live")
        like = written(like.join(open_.select("seq"), "seq", "left_semi"))
        wave += 1

    shown = F.when((F.col("note") != "") & ~F.contains("full_text", F.col("note")), F.concat("full_text", F.lit(SUPPLEMENT), "note")).otherwise(F.col("full_text"))
    columns = ["ord", "version", *FIELDS]
    decisions = reduce(DataFrame.unionByName, settled_for, state).withColumn("full_text", shown).select(*columns).unionByName(apart.select(*columns))
    if not outcomes:
        empty = lambda schema: spark.createDataFrame([], schema)
        return Intake(decisions, empty("seq long, sid string, outcome string, target string, wave int"), empty("sid string, other string"))
    pairs = reduce(DataFrame.unionByName, conflicts)
    both = pairs.unionByName(pairs.select(F.col("other").alias("sid"), F.col("sid").alias("other"))).distinct()
    return Intake(decisions, reduce(DataFrame.unionByName, outcomes), both)


def _settled(rows: DataFrame, sure: float) -> DataFrame:
    """``rows`` with outcome (updated, merged, dropped or created), target (a sid), info and against (sids of conflicts)."""
    sim = F.col("sim")
    into = F.when((sim["a"] >= sure) | (sim["action"] == "update"), sim["e"])
    info = F.when((sim["a"] < sure) & (sim["action"] == "update"), sim["info"]).otherwise("")
    begin = F.struct(
        F.coalesce((sim["a"] < sure) & (sim["action"] == "skip"), F.lit(False)).alias("dropped"),
        F.lit(False).alias("ended"),
        into.alias("target"),
        info.alias("info"),
        F.when((sim["a"] < sure) & (sim["action"] == "conflict"), F.array(sim["e"])).otherwise(F.array().cast("array<string>")).alias("against"),
    )

    def step(s: Column, x: Column) -> Column:
        new = lambda **k: F.struct(*[k.get(n, s[n]).alias(n) for n in ("dropped", "ended", "target", "info", "against")])
        passed = s["dropped"] | s["ended"] | x["e"].eqNullSafe(s["target"])
        sent = F.when(x["info"] != "", x["info"]).otherwise(s["info"])
        return F.when(passed, s).when(x["action"] == "skip", new(dropped=F.lit(True))).when(x["action"] == "update", new(ended=F.lit(True), target=x["e"], info=sent)).otherwise(new(against=F.array_append(s["against"], x["e"])))

    none = F.array().cast("array<struct<ord:bigint,e:string,action:string,info:string>>")
    folded = rows.withColumn("f", F.aggregate(F.coalesce("rest", none), begin, step))
    known = F.col("how").isNotNull()
    outcome = F.when(known, "updated").when(F.col("f.dropped"), "dropped").when(F.col("f.target").isNotNull(), "merged").otherwise("created")
    own = folded.withColumn("outcome", outcome).withColumn("target", F.when(F.col("outcome") == "merged", F.col("f.target")).otherwise(F.col("sid")))
    return own.withColumn("info", F.when(known, "").otherwise(F.col("f.info"))).withColumn("against", F.when(known, F.array().cast("array<string>")).otherwise(F.col("f.against"))).drop("f", "sim", "rest", "how")


def _applied(state: DataFrame, settled: DataFrame, top: int) -> DataFrame:
    """The decisions after the rows of one wave; no two of these have one target."""
    kept = [c for c in state.columns if c != "sid"]
    row = settled.filter("outcome <> 'created'").select(F.col("target").alias("sid"), F.struct("seq", *[c for c in FIELDS if c != "sid"], "info", "outcome").alias("r"))
    joined = state.join(row, "sid", "left")
    r = lambda c: F.col(f"r.{c}")
    merged = r("outcome") == "merged"
    text = _filled(r("full_text")) | _filled(r("info"))
    title = F.when(_filled(r("title")), r("title")).otherwise(r("summary"))
    put = {
        "title": F.when(_filled(title), title).otherwise(F.col("title")),
        "summary": F.when(_filled(r("summary")), r("summary")).otherwise(F.col("summary")),
        "s_src": F.when(_filled(r("summary")), r("seq")).otherwise(F.col("s_src")),
        "full_text": F.when(text, r("full_text")).otherwise(F.col("full_text")),
        "f_src": F.when(text, r("seq")).otherwise(F.col("f_src")),
        "note": F.when(text, r("info")).otherwise(F.col("note")),
        "impact_level": F.when(_filled(r("impact_level")), r("impact_level")).otherwise(F.col("impact_level")),
        "confidence": F.when(merged, F.greatest(r("confidence"), F.col("confidence"))).otherwise(r("confidence")),
        "tags": F.when(merged, F.array_sort(F.array_union(r("tags"), F.col("tags")))).when(F.size(r("tags")) > 0, r("tags")).otherwise(F.col("tags")),
        "version": F.col("version") + 1,
    }
    changed = joined.select("sid", *[F.when(F.col("r").isNull(), F.col(c)).otherwise(put[c]).alias(c) if c in put else F.col(c) for c in kept])
    made = settled.filter("outcome = 'created'")
    title = F.when(_filled(F.col("title")), F.col("title")).otherwise(F.col("summary"))
    fresh = {"ord": F.lit(top) + 1 + F.col("seq"), "version": F.lit(1).cast("long"), "s_src": F.col("seq"), "f_src": F.col("seq"), "note": F.col("info"), "title": title, "status": F.when(_filled(F.col("status")), F.col("status")).otherwise("pending")}
    return changed.unionByName(made.select("sid", *[fresh.get(c, F.col(c)).alias(c) for c in kept]))
