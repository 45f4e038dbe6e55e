"""Matching of expected and found decisions and the measures of an evaluation.

Expected rows have chat, e (their order), topic, summary, suggestion and status; found rows chat, a,
topic, summary, suggestion, status. A chat is a session that people have labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.scores import precision_recall_f1, ratio
from threadloom.functions.status import is_confirmed
from threadloom.functions.text import character_overlap, token_overlap
from threadloom.functions.vector import dot, normalise
from threadloom.operators.likeness import like_between, pair_likeness
from threadloom.operators.selection import values_at
from threadloom.sources.scratch import written


def greedy(pairs: DataFrame) -> DataFrame:
    """(chat, l, r, score): each l, in order, takes the r of its chat with the highest score that none before it took; ties go to the smaller r.

    pairs: chat, l, r, score. Only pairs that may match come here. Whom an l gets hangs on all
    before it, so a chat's pairs stream through one task in order; it only holds what is taken.
    """
    schema = pairs.select("chat", "l", "r", "score").schema

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat, done, taken = None, None, set()
        for rows in batches:
            kept = []
            for i, (c, l, r) in enumerate(zip(rows["chat"], rows["l"], rows["r"], strict=True)):
                if c != chat:
                    chat, done, taken = c, None, set()
                if l != done and r not in taken:
                    done = l
                    taken.add(r)
                    kept.append(i)
            yield rows.iloc[kept]

    dealt = pairs.filter("chat IS NOT NULL").select("chat", "l", "r", "score").repartition("chat").sortWithinPartitions("chat", "l", F.desc("score"), "r")
    return dealt.mapInPandas(settle, schema)


def _sides(expected: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with chats and topics that are null where blank, and stripped summaries."""
    clear = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    chat = F.nullif(F.col("chat"), F.lit(""))
    e = expected.select(chat.alias("chat"), F.col("e").alias("l"), clear(F.col("topic")).alias("et"), F.trim("summary").alias("es"), F.coalesce("suggestion", F.lit(False)).alias("eg"))
    a = found.select(chat.alias("chat"), F.col("a").alias("r"), clear(F.col("topic")).alias("at"), F.trim("summary").alias("s"), F.coalesce("suggestion", F.lit(False)).alias("ag"))
    return e, a.withColumn("wild", F.coalesce(F.col("at") == "general", F.lit(True)))


def _enough(eg: str = "eg", ag: str = "ag") -> Column:
    return F.when(F.col(eg) == F.col(ag), 0.3).otherwise(0.45)


def candidates(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(chat, l, r, score): pairs of one chat and, but for rows without a topic and found rows of the topic 'general', of one topic whose summaries are alike enough.

    0.3 is enough for two decisions or two suggestions, 0.45 for one of each. Topics and summaries are stripped.
    """
    e, a = _sides(expected, found)
    # equal topics meet by a join on them; only rows without a topic of their own meet the whole chat
    same = e.join(a.filter(~F.col("wild")).withColumnRenamed("at", "et"), ["chat", "et"])
    rest = e.join(a.filter("wild"), "chat").drop("at").unionByName(e.filter("et IS NULL").join(a.filter(~F.col("wild")), "chat").drop("at"))
    pairs = same.unionByName(rest)
    scored = pairs.withColumn("score", F.round(character_overlap("es", "s"), 9))
    return scored.filter(F.col("score") >= _enough()).select("chat", "l", "r", "score")


def open_candidates(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(chat, l, found_chat, r, score): the pairs in which one row has no chat; such a row may match one of any chat.

    They are compared in tiles within a topic; what has no topic meets all.
    """
    e, a = _sides(expected, found)
    chars = lambda c: F.transform(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")), lambda x: F.ascii(x).cast("long"))
    topic = lambda c: F.concat(F.lit("t:"), F.col(c))
    blocks = F.array_compact(F.array(topic("et"), F.lit("wild"), F.when(F.col("et").isNull(), F.lit("none"))))
    own = e.select(F.explode(blocks).alias("block"), F.struct("chat", "l", "eg").alias("id"), chars(F.col("es")).alias("grams")).filter("size(grams) > 0")
    blocks = F.when(F.col("wild"), F.array(F.lit("wild"))).otherwise(F.array(topic("at"), F.lit("none")))
    other = a.select(F.explode(blocks).alias("block"), F.struct("chat", "r", "ag").alias("id"), chars(F.col("s")).alias("grams")).filter("size(grams) > 0")
    lack, have = F.col("id.chat").isNull(), F.col("id.chat").isNotNull()
    pairs = like_between(own.filter(lack), other, 0.29, True).unionByName(like_between(own.filter(have), other.filter(lack), 0.29, True))
    scored = pairs.select("id.chat", "id.l", "id.eg", F.col("other.chat").alias("found_chat"), "other.r", "other.ag", F.round("similarity", 9).alias("score"))
    return scored.filter(F.col("score") >= _enough()).select("chat", "l", "found_chat", "r", "score")


def greedy_rounds(pairs: DataFrame) -> DataFrame:
    """``greedy`` over pairs (l, r, score) that no chat parts: in each round every l that no earlier open one can disturb takes its best free r.

    An l goes first if it is the first of all open ones that have its best r among their pairs.
    The rounds are as many as the longest chain of ls that wait for each other.
    """
    open_, taken = written(pairs.select("l", "r", "score")), []
    while not open_.isEmpty():
        best = open_.groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("s"), "r")).alias("b")).select("l", "b.r", (-F.col("b.s")).alias("score"))
        first = open_.groupBy("r").agg(F.min("l").alias("first"))
        settled = written(best.join(first, "r").filter("l = first").select("l", "r", "score"))
        taken.append(settled)
        open_ = written(open_.join(settled.select("l"), "l", "left_anti").join(settled.select("r"), "r", "left_anti"))
    return reduce(DataFrame.unionByName, taken) if taken else open_


def matched(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(chat, l, found_chat, r, score): which found row each expected row gets, one to one, in the order of e.

    While all rows have a chat, each chat is settled by itself. A row without one may match in any
    chat, so then the order of all rows counts: that of e, of equal ones that of the chat, and of
    equally good found rows the one of smaller a, then chat, is taken.
    """
    own = candidates(expected, found)
    nameless = lambda df: df.filter("coalesce(chat, '') = ''").isEmpty()
    if nameless(expected) and nameless(found):
        return greedy(own).select("chat", "l", F.col("chat").alias("found_chat"), "r", "score")
    pairs = own.select("chat", "l", F.col("chat").alias("found_chat"), "r", "score").unionByName(open_candidates(expected, found))
    settled = greedy_rounds(pairs.select(F.struct("l", "chat").alias("l"), F.struct("r", F.col("found_chat").alias("chat")).alias("r"), "score"))
    return settled.select("l.chat", "l.l", F.col("r.chat").alias("found_chat"), "r.r", "score")


def judged(expected: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each expected row (outcome tp or fn) and each found row that counts against (fp), by the ``matched`` ones.

    Suggestions, rows of a topic that is expected anywhere, and rows without a topic of their own
    don't count against. Topics are stripped.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    topic = F.trim("topic").alias("topic")
    m = written(matches.select(F.col("chat").alias("m_chat"), F.col("l").alias("m_e"), "found_chat", F.col("r").alias("m_a")))
    e = expected.select("chat", "e", topic, "status", F.coalesce("suggestion", F.lit(False)).alias("suggestion"))
    f = found.select(F.col("chat").alias("f_chat"), "a", topic, "status", F.coalesce("suggestion", F.lit(False)).alias("suggestion"))
    hits = e.join(m, blank(F.col("chat")).eqNullSafe(F.col("m_chat")) & (F.col("e") == F.col("m_e")), "left")
    theirs = f.select("f_chat", "a", F.col("topic").alias("found_topic"), F.col("status").alias("found_status"))
    own = hits.join(theirs, blank(F.col("f_chat")).eqNullSafe(F.col("found_chat")) & (F.col("a") == F.col("m_a")), "left")
    rows = own.select("chat", "topic", "status", "suggestion", F.when(F.col("m_e").isNull(), "fn").otherwise("tp").alias("outcome"), (F.col("topic") == F.col("found_topic")).alias("topic_right"), (F.col("status") == F.col("found_status")).alias("status_right"))
    known = e.filter("topic <> ''").select("topic").distinct()
    taken = f.join(m, blank(F.col("f_chat")).eqNullSafe(F.col("found_chat")) & (F.col("a") == F.col("m_a")), "left_anti")
    extra = taken.filter("NOT suggestion AND coalesce(topic, '') NOT IN ('', 'general', 'unknown')").join(known, "topic", "left_anti")
    against = extra.select(F.col("f_chat").alias("chat"), "topic", "status", F.lit(False).alias("suggestion"), F.lit("fp").alias("outcome"), F.lit(False).alias("topic_right"), F.lit(False).alias("status_right"))
    return rows.unionByName(against)


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")]


def _measures(df: DataFrame, places: int = 4) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select("*", *[F.round(c, places).alias(n) for n, c in precision_recall_f1(tp, fp, fn).items()])


def metrics(rows: DataFrame) -> DataFrame:
    """One row of counts, precision, recall and F1, those by type, and how often topic and state are right."""
    n = lambda test, name: F.count_if(test).alias(name)
    tp = F.col("outcome") == "tp"
    c = rows.agg(*_counts(), n(tp & ~F.col("suggestion"), "decision_tp"), n((F.col("outcome") == "fn") & ~F.col("suggestion"), "decision_fn"), n(tp & F.col("suggestion"), "suggestion_tp"), n((F.col("outcome") == "fn") & F.col("suggestion"), "suggestion_fn"), n(tp & F.col("topic_right"), "topics"), n(tp & F.col("status_right"), "states"))
    share = lambda part, whole, name: F.round(ratio(part, whole), 4).alias(name)
    col = F.col
    return _measures(c).select("tp", "fp", "fn", "precision", "recall", "f1", share(col("decision_tp"), col("tp") + col("fp"), "decision_precision"), share(col("decision_tp"), col("decision_tp") + col("decision_fn"), "decision_recall"), share(col("suggestion_tp"), col("suggestion_tp") + col("suggestion_fn"), "suggestion_recall"), share(col("topics"), col("tp"), "topic_accuracy"), share(col("states"), col("tp"), "status_accuracy"))


def metrics_by(rows: DataFrame, by: str) -> DataFrame:
    """Counts, precision, recall and F1 of each group."""
    return _measures(rows.groupBy(by).agg(*_counts()))


def isolation(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(violations, score): pairs of an expected and a found row of one topic and different chats, by counts and not by pairs; 1 is best."""
    e = expected.filter("coalesce(topic, '') <> '' AND coalesce(chat, '') <> ''").groupBy("topic", "chat").agg(F.count("*").alias("ne"))
    a = found.filter("coalesce(topic, '') <> '' AND coalesce(chat, '') <> ''").groupBy("topic", "chat").agg(F.count("*").alias("na"))
    all_pairs = e.groupBy("topic").agg(F.sum("ne").alias("e")).join(a.groupBy("topic").agg(F.sum("na").alias("a")), "topic").agg(F.coalesce(F.sum(F.col("e") * F.col("a")), F.lit(0)).alias("pairs"))
    same = e.join(a, ["topic", "chat"]).agg(F.coalesce(F.sum(F.col("ne") * F.col("na")), F.lit(0)).alias("same"))
    total = expected.agg(F.count("*").alias("total"))
    one = all_pairs.crossJoin(same).crossJoin(total)  # three tables of one row
    v = F.col("pairs") - F.col("same")
    return one.select(v.alias("violations"), F.round(F.when(F.col("total") > 0, 1 - v / F.col("total")).otherwise(1.0), 4).alias("score"))


def recall_by_gap(expected: DataFrame, found: DataFrame, sessions: DataFrame, gaps: tuple[int, ...] = (0, 1, 3, 7, 14)) -> DataFrame:
    """(gap, total, correct, recall): for each pair of an earlier and a later session (chat, session, day_gap) of a chat, how many decisions of the earlier one are found.

    The later session's day gap counts as the nearest of ``gaps``, the smaller among equals. Found
    means that a found row of the chat and topic has a summary that is alike by 0.3.
    """
    pairs = expected.select("chat", "e", "topic", "summary").join(found.select("chat", "topic", F.col("summary").alias("s")), ["chat", "topic"])
    hit = pairs.filter(F.round(character_overlap("summary", "s"), 9) >= 0.3).select("chat", "e").distinct().withColumn("hit", F.lit(1))
    # what an earlier session adds is counted once, then laid against the later sessions
    per = expected.join(hit, ["chat", "e"], "left").groupBy("chat", "session").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    later = sessions.select("chat", F.col("session").alias("after"), "day_gap")
    joined = per.join(later, "chat").filter("session < after")
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("day_gap") - g).alias("d"), F.lit(g).alias("g")) for g in gaps]))["g"]
    by = joined.groupBy(nearest.alias("gap")).agg(F.sum("n").alias("total"), F.sum("hits").alias("correct"))
    every = by.sparkSession.createDataFrame([(g,) for g in gaps], "gap int")
    return every.join(by, "gap", "left").select("gap", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("correct", F.lit(0)).alias("correct"), F.round(F.coalesce(F.col("correct") / F.col("total"), F.lit(0.0)), 4).alias("recall"))


def decay(by_gap: DataFrame) -> DataFrame:
    """(consistency, decay_rate, half_life) from ``recall_by_gap``."""
    at = lambda g: F.max(F.when(F.col("gap") == g, F.col("recall")))
    one = by_gap.agg(at(0).alias("r0"), at(14).alias("r14"), F.sum("correct").alias("c"), F.sum("total").alias("t"))
    rate = F.when(F.col("r0") > 0, (F.col("r0") - F.col("r14")) / 14.0)
    return one.select(F.round(ratio(F.col("c"), F.col("t")), 4).alias("consistency"), F.round(rate, 4).alias("decay_rate"), F.when(rate > 0, F.round(0.5 / rate, 1)).alias("half_life"))


def noise_robustness(found: DataFrame) -> DataFrame:
    """(overall, variance, score) of the share of false positives (fp: boolean) over groups of noise_ratio, null as 0."""
    rates = found.groupBy(F.coalesce("noise_ratio", F.lit(0.0)).alias("nr")).agg(F.count_if("fp").alias("fp"), F.count("*").alias("n")).withColumn("rate", F.round(F.col("fp") / F.col("n"), 4))
    return rates.agg(F.round(F.sum("fp") / F.sum("n"), 4).alias("overall"), F.round(F.var_pop("rate"), 4).alias("variance"), F.round(F.greatest(F.lit(0.0), 1 - F.avg("rate")), 4).alias("score"))


def _evidence(outputs: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat, a, evidence, quoted): as in ``evidence_valid``, and the cited messages that hold the quote."""
    cited = outputs.select("chat", "a", "quote", F.explode("cited").alias("msg_id"))
    found = cited.join(messages.select("chat", "msg_id", "msg", F.lit(True).alias("known")), ["chat", "msg_id"], "left")
    known, held = F.coalesce("known", F.lit(False)), F.coalesce(F.col("known") & (F.col("quote") != "") & F.contains("msg", F.col("quote")), F.lit(False))
    return found.groupBy("chat", "a").agg((F.bool_and(known) & F.bool_or(held)).alias("evidence"), F.collect_set(F.when(held, F.col("msg_id"))).alias("quoted"))


def evidence_valid(outputs: DataFrame, messages: DataFrame) -> DataFrame:
    """``outputs`` (chat, a, cited: array, quote, ...) with evidence: whether all cited messages exist and one of them holds the quote."""
    return outputs.join(_evidence(outputs, messages).drop("quoted"), ["chat", "a"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(False)))


def strict_outcomes(outputs: DataFrame, expected: DataFrame, messages: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(chat, a, outcome, matched, reason) of every confirmed output.

    Outputs without valid evidence are invalid. One that cites an expected row's message (chat, e,
    msg_id) and quotes it matches the first such row that none before it took. Of the rest a judge's
    verdicts (chat, a, verdict, matched) count: match_gt if the row is free, else invalid;
    valid_extra; invalid. Without a verdict an output is invalid.
    """
    confirmed = outputs.filter(is_confirmed(F.col("kind"), F.col("suggestion"), F.col("status")))
    # several branches read the evidence and the exact matches, so each is made once
    own = written(confirmed.select("chat", "a").join(_evidence(confirmed, messages), ["chat", "a"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(False))))
    bad = own.filter("NOT evidence").select("chat", "a", F.lit("invalid").alias("outcome"), F.lit("").alias("matched"), F.lit("missing_or_invalid_evidence").alias("reason"))
    good = own.filter("evidence")
    cited = good.select("chat", "a", F.explode("quoted").alias("msg_id"))
    pairs = cited.join(expected.select("chat", "msg_id", "e"), ["chat", "msg_id"]).select("chat", F.col("a").alias("l"), F.col("e").alias("r"), (-F.col("e")).cast("double").alias("score")).distinct()
    exact = greedy(pairs).join(expected.select("chat", F.col("e").alias("r"), "msg_id"), ["chat", "r"]).select("chat", F.col("l").alias("a"), F.lit("match_gt").alias("outcome"), F.col("msg_id").alias("matched"), F.lit("exact_source_match").alias("reason"))
    exact = written(exact)
    rest = good.select("chat", "a").join(exact.select("chat", "a"), ["chat", "a"], "left_anti")
    if verdicts is None:
        left = rest.select("chat", "a", F.lit("invalid").alias("outcome"), F.lit("").alias("matched"), F.lit("no_adjudicator").alias("reason"))
        return bad.unionByName(exact).unionByName(left)
    v = rest.join(verdicts.select("chat", "a", "verdict", F.coalesce("matched", F.lit("")).alias("matched")), ["chat", "a"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("invalid")))
    v = v.join(exact.select("chat", "matched", F.lit(True).alias("gone")), ["chat", "matched"], "left").join(expected.select("chat", F.col("msg_id").alias("matched"), F.lit(True).alias("exists")).distinct(), ["chat", "matched"], "left")
    first = F.row_number().over(W.partitionBy("chat", "matched", "verdict").orderBy("a")) == 1
    free = (F.col("verdict") == "match_gt") & F.col("gone").isNull() & F.col("exists") & first
    outcome = F.when(F.coalesce(free, F.lit(False)), "match_gt").when(F.col("verdict") == "valid_extra", "valid_extra").otherwise("invalid")
    left = v.select("chat", "a", outcome.alias("outcome"), F.when(outcome == "match_gt", F.col("matched")).otherwise("").alias("matched"), F.when((F.col("verdict") == "match_gt") & (outcome == "invalid"), "duplicate_or_unknown_match").otherwise(F.col("verdict")).alias("reason"))
    return bad.unionByName(exact).unionByName(left)


def strict_metrics(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: strict counts, extras, evidence, precision, recall and F1. What is invalid is a false positive; extras count neither way."""
    n = lambda test, name: F.count_if(test).alias(name)
    c = outcomes.agg(n(F.col("outcome") == "match_gt", "tp"), n(F.col("outcome") == "invalid", "fp"), n(F.col("outcome") == "valid_extra", "valid_extra"), n(F.col("reason") == "missing_or_invalid_evidence", "evidence_invalid"))
    both = c.crossJoin(expected.agg(F.count("*").alias("total")))  # two tables of one row
    return _measures(both.withColumn("fn", F.col("total") - F.col("tp"))).select("tp", "fp", "fn", "valid_extra", "evidence_invalid", "precision", "recall", "f1")


def unmatched(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """The expected rows that no output matches."""
    return expected.join(outcomes.filter("outcome = 'match_gt'").select("chat", F.col("matched").alias("msg_id")), ["chat", "msg_id"], "left_anti")


def assignment_errors(rows: DataFrame, outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """(chat, a, error) of a judge's assignment (chat, a, verdict, matched): each output must have one row, each expected row one match at most."""
    seen = rows.groupBy("chat", "a").agg(F.count("*").alias("n"))
    error = lambda df, text: df.select("chat", "a", F.lit(text).alias("error"))
    hits = rows.filter("verdict = 'match_gt'")
    parts = [
        error(outputs.select("chat", "a").join(seen, ["chat", "a"], "left_anti"), "missing"),
        error(seen.join(outputs.select("chat", "a"), ["chat", "a"], "left_anti"), "unknown output"),
        error(seen.filter("n > 1"), "repeated"),
        error(hits.filter("coalesce(matched, '') = ''"), "match without a row"),
        error(rows.filter("verdict <> 'match_gt' AND coalesce(matched, '') <> ''"), "row without a match"),
        error(hits.filter("matched <> ''").join(expected.select("chat", F.col("msg_id").alias("matched")), ["chat", "matched"], "left_anti"), "unknown row"),
        error(hits.filter("matched <> ''").withColumn("k", F.row_number().over(W.partitionBy("chat", "matched").orderBy("a"))).filter("k > 1"), "row matched again"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_matches(expected: DataFrame, found: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(a, e, score): the expected row (e, ``key``, topic, summary) that each found one (a, ``key``, summary and body) is most like, whoever else takes it; the first of equal ones.

    The score is the higher of the bigram similarities of the summary and, times 0.7, of the body
    with the expected summary; 0.15 more, up to 1, where the found text holds a character of the
    expected topic, white space aside. Scores under ``least`` are no match.
    """
    body = F.col("body") if "body" in found.columns else F.lit("")
    text = lambda c: F.coalesce(c, F.lit(""))
    f = found.select("a", key, text(F.col("summary")).alias("s"), text(body).alias("b"))
    pairs = f.join(expected.select("e", key, text(F.col("summary")).alias("es"), text(F.col("topic")).alias("topic")), key)
    alike = F.greatest(pair_likeness(F.col("s"), F.col("es"), False), 0.7 * pair_likeness(F.col("b"), F.col("es"), False))
    held = F.lower(F.concat_ws(" ", "s", "b"))
    named = (F.col("s") != "") & F.exists(F.filter(F.split(F.lower(F.regexp_replace("topic", " ", "")), ""), lambda c: c != ""), lambda c: F.contains(held, c))
    scored = pairs.select("a", "e", F.round(F.least(F.lit(1.0), alike + F.when(named, 0.15).otherwise(0.0)), 9).alias("score")).filter(F.col("score") >= least)
    return scored.groupBy("a").agg(F.max_by(F.struct("e", "score"), F.struct("score", -F.col("e"))).alias("b")).select("a", "b.*")


#: Scenarios and the measure that each is the base of.
SCENARIOS = ["web_simple_extract", "web_fact_update", "web_stale_rejection", "web_cross_session", "web_multi_source_merge", "web_distractor_tolerance"]


def scenario_matches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected rows (e, scenario, chat, topic, summary, effect_summary, effect, conflict) that have a scenario, with a: the first found row (a, chat, topic, summary) of the same chat and topic that is like the effect, or else the summary, and effect_met, whether it is like the effect.

    Alike are texts that share 0.3 of the distinct characters of the richer one. Null chats and topics count as empty.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    e = expected.filter("coalesce(scenario, '') NOT IN ('', 'unknown')")
    e = e.withColumns({"chat": text(F.col("chat")), "topic": text(F.col("topic")), "wanted": F.coalesce(F.nullif("effect_summary", F.lit("")), text(F.col("summary")))})
    f = found.select(text(F.col("chat")).alias("chat"), text(F.col("topic")).alias("topic"), "a", text(F.col("summary")).alias("s"))
    pairs = e.select("e", "chat", "topic", "wanted").join(f, ["chat", "topic"]).filter(F.round(character_overlap("wanted", "s"), 9) >= 0.3)
    best = pairs.groupBy("e").agg(F.min("a").alias("a"))
    own = e.join(best, "e", "left").join(f.select(F.col("a"), F.col("s").alias("found_summary")), "a", "left")
    return own.withColumn("effect_met", F.coalesce(F.round(character_overlap(text(F.col("effect_summary")), text(F.col("found_summary"))), 9) >= 0.3, F.lit(False)))


def scenario_measures(matches: DataFrame) -> DataFrame:
    """One row of the measures of ``scenario_matches``; a measure without a case is 0."""
    hit, named = F.col("a").isNotNull(), lambda k: F.col("scenario") == k
    clash = F.coalesce("conflict", F.lit(False))
    share = lambda good, base: F.coalesce(F.try_divide(F.count_if(good & base), F.count_if(base)), F.lit(0.0))
    noise = (F.coalesce("effect", F.lit("")).isin("no_change", "") & ~hit) | ((F.col("effect") == "new_decision") & hit)
    return matches.agg(
        share(hit, named(SCENARIOS[0])).alias("extraction_accuracy"),
        share(hit & F.col("effect_met"), named(SCENARIOS[1])).alias("update_correctness"),
        share(hit, clash).alias("conflict_detection_rate"),
        F.lit(0.0).alias("conflict_detection_fpr"),  # nothing is ever counted as detected beyond the expected ones
        share(hit, clash & hit).alias("conflict_resolution_accuracy"),
        share(~hit, named(SCENARIOS[2])).alias("stale_consistency"),
        share(hit, named(SCENARIOS[3])).alias("cross_session_recall"),
        share(hit, named(SCENARIOS[4])).alias("merge_quality"),
        share(F.coalesce(noise, F.lit(False)), named(SCENARIOS[5])).alias("noise_filter_ratio"),
    )


def token_matched(expected: DataFrame, found: DataFrame, key: str, least: float = 0.30) -> DataFrame:
    """The expected rows some found row of the same key shares enough tokens with."""
    pairs = expected.select("e", key, "summary").join(found.select(key, F.col("summary").alias("s")), key)
    return pairs.filter(F.round(token_overlap("summary", "s"), 9) >= least).select("e").distinct()


def merged_reports(reports: DataFrame) -> DataFrame:
    """One row: micro measures from sums of (tp, fp, fn) and macro ones, the mean and spread of each chat's F1."""
    each = _measures(reports, 9)
    one = each.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *[F.round(f("f1"), 6).alias(f"macro_{n}") for n, f in (("mean", F.avg), ("stddev", F.stddev_pop), ("min", F.min), ("max", F.max))])
    return _measures(one, 6)


def repeated_runs(reports: DataFrame, value: str, least: float) -> DataFrame:
    """One row: mean, population deviation, extremes of a measure over runs, and the share of runs that reach ``least``."""
    return reports.agg(F.count("*").alias("runs"), *[F.round(f(value), 6).alias(n) for n, f in (("mean", F.avg), ("stddev", F.stddev_pop), ("min", F.min), ("max", F.max))], F.round(F.avg((F.col(value) >= least).cast("double")), 6).alias("pass_rate"))


def class_scores(rows: DataFrame, expected: str, found: str, classes: list) -> DataFrame:
    """(class, tp, fp, fn, precision, recall, f1, macro_f1) from rows of an expected and a found class; a null found class is none of them."""
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    each = [F.struct(F.lit(c).alias("class"), n((F.col(expected) == c) & (F.col(found) == c)).alias("tp"), n((F.col(expected) != c) & (F.col(found) == c)).alias("fp"), n((F.col(expected) == c) & ~F.coalesce(F.col(found) == c, F.lit(False))).alias("fn")) for c in classes]
    table = _measures(rows.agg(F.array(*each).alias("c")).select(F.explode("c").alias("c")).select("c.*"), 9)  # a row for each class
    return table.withColumn("macro_f1", F.round(F.avg("f1").over(W.partitionBy()), 9))


def agreement(runs: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: the share of keys that all runs give one value."""
    each = runs.groupBy(*key).agg((F.count_distinct(value) == 1).cast("double").alias("same"))
    return each.agg(F.count("*").alias("keys"), F.round(F.avg("same"), 9).alias("agreement"))


def _at_ranks(values: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(key, one column for each of ``ranks``): the values at places that are given by expressions over n, the number of a key's values."""
    sizes = values.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    wanted = sizes.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ranks]), F.array(*[r.cast("long") for r in ranks.values()]))).alias("name", "rank"))
    found = wanted.join(values_at(values, key, value, wanted.select(key, "rank")), [key, "rank"], "left")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ranks])


def query_report(results: DataFrame, by: str, value: str, right: str) -> DataFrame:
    """(group, n, match_rate, mean, p50, p95) over all and by group; percentiles are the values at floor(n * p), at most the last."""
    both = results.select(F.explode(F.array(F.lit("all"), F.coalesce(F.col(by).cast("string"), F.lit("?")))).alias("group"), F.col(value).cast("double").alias("v"), F.col(right).cast("double").alias("ok"))
    each = both.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("match_rate"), F.round(F.avg("v"), 6).alias("mean"))
    at = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return each.join(_at_ranks(both, "group", "v", {"p50": at(0.5), "p95": at(0.95)}), "group", "left").select("group", "n", "match_rate", "mean", "p50", "p95")


def timings(rows: DataFrame, key: str, ms: str) -> DataFrame:
    """(key, n, mean, median, p95, max, min, rate) of times in milliseconds: median and p95 at floor(n * p), p95 0 for fewer than 20; rate is rows a second of their sum, 0 if that is 0."""
    v = rows.select(F.col(key), F.col(ms).cast("double").alias("v")).filter("v IS NOT NULL")
    one = lambda c: F.round(c, 1)
    each = v.groupBy(key).agg(F.count("*").alias("n"), one(F.avg("v")).alias("mean"), one(F.max("v")).alias("max"), one(F.min("v")).alias("min"), F.sum("v").alias("total"))
    at = _at_ranks(v, key, "v", {"median": F.floor(F.col("n") / 2), "p95": F.floor(F.col("n") * 0.95)})
    rate = F.when(F.col("total") > 0, F.round(F.col("n") / (F.col("total") / 1000), 2)).otherwise(0.0)
    return each.join(at, key, "left").select(key, "n", "mean", one(F.col("median")).alias("median"), F.when(F.col("n") >= 20, one(F.col("p95"))).otherwise(0.0).alias("p95"), "max", "min", rate.alias("rate"))


def memory_use(snapshots: DataFrame, key: str, order: list[str], rss: str) -> DataFrame:
    """(key, snapshots, mean, peak, final) of memory in megabytes; final is the last in ``order``."""
    one = lambda c: F.round(c, 1)
    return snapshots.groupBy(key).agg(F.count("*").alias("snapshots"), one(F.avg(rss)).alias("mean"), one(F.max(rss)).alias("peak"), one(F.max_by(rss, F.struct(*order))).alias("final"))


def separation(members: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(level, topics, largest, per_topic, intra, inter, ratio) of clusters (level, id, cluster) of vectors (id, vector) of ``width`` components.

    ``intra`` is the mean, over members with others in their cluster, of a member's mean cosine
    distance to these, and ``inter`` that of its mean distance to all foreign members. Both come
    from the clusters' sums of unit vectors: n members of sum S have a total similarity of
    |S| ** 2. No pair of members is made.
    """
    unit = vectors.select("id", normalise(F.col("vector")).alias("u"))
    joined = members.join(unit, "id")
    total = lambda name: F.array(*[F.sum(F.col(name)[k]) for k in range(width)])
    own = joined.groupBy("level", "cluster").agg(F.count("*").alias("n"), F.sum(dot(F.col("u"), F.col("u"))).alias("q"), total("u").alias("s"))
    every = own.groupBy("level").agg(F.sum("n").alias("all_n"), total("s").alias("all_s"))
    c = own.join(every, "level")
    inside = dot(F.col("s"), F.col("s"))
    across = dot(F.col("s"), F.col("all_s")) - inside
    n, rest = F.col("n"), F.col("all_n") - F.col("n")
    c = c.select("level", "n", F.when(n > 1, n - (inside - F.col("q")) / (n - 1)).alias("intra"), F.when(n > 1, n).alias("intra_n"), F.when(rest > 0, n - across / rest).alias("inter"), F.when(rest > 0, n).alias("inter_n"))
    mean = lambda x: F.coalesce(F.try_divide(F.sum(x), F.sum(f"{x}_n")), F.lit(0.0))
    level = c.groupBy("level").agg(F.count("*").alias("topics"), F.max("n").alias("largest"), (F.sum("n") / F.count("*")).alias("per_topic"), mean("intra").alias("intra"), mean("inter").alias("inter"))
    four = lambda x: F.round(x, 4)
    return level.select("level", "topics", "largest", four(F.col("per_topic")).alias("per_topic"), four(F.col("intra")).alias("intra"), four(F.col("inter")).alias("inter"), four(F.col("inter") / F.greatest(F.col("intra"), F.lit(1e-9))).alias("ratio"))


def granularity(members: DataFrame, lengths: DataFrame, short: int = 3, long: int = 5) -> DataFrame:
    """One row (n_short, n_long, short_level, long_level, difference): the mean finest level of members with few and with many messages (id, length)."""
    finest = members.groupBy("id").agg(F.max("level").alias("level")).join(lengths, "id")
    side = lambda test, name: [F.count_if(test).alias(f"n_{name}"), F.coalesce(F.round(F.avg(F.when(test, F.col("level"))), 2), F.lit(0.0)).alias(f"{name}_level")]
    row = finest.agg(*side(F.col("length") <= short, "short"), *side(F.col("length") > long, "long"))
    return row.select("n_short", "n_long", "short_level", "long_level", F.round(F.col("short_level") - F.col("long_level"), 2).alias("difference"))


def purity(rows: DataFrame, cluster: str, topic: str) -> DataFrame:
    """(cluster, n, purity): the share of a cluster's commonest topic."""
    c = rows.groupBy(cluster, topic).agg(F.count("*").alias("k"))
    return c.groupBy(F.col(cluster).alias("cluster")).agg(F.sum("k").alias("n"), F.round(F.max("k") / F.sum("k"), 6).alias("purity"))


def misses_by_topic(rows: DataFrame, most: int = 20) -> DataFrame:
    """(topic, n): the topics with the most expected rows that weren't found."""
    return rows.filter("outcome = 'fn'").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(most)


def stratified_split(rows: DataFrame, domain: str, key: str, score: str, tag: str) -> DataFrame:
    """``key``, ``domain`` and part: of each domain the two lowest and two highest scores and the best tagged one of those between are dev, the rest is holdout."""
    up, down = W.partitionBy(domain).orderBy(score, key), W.partitionBy(domain).orderBy(F.desc(score), F.desc(key))
    r = rows.withColumn("low", F.row_number().over(up)).withColumn("high", F.row_number().over(down))
    edge = (F.col("low") <= 2) | (F.col("high") <= 2)
    r = r.withColumn("edge", edge).withColumn("middle", F.row_number().over(W.partitionBy(domain, "edge").orderBy(F.desc(tag), key)))
    return r.select(key, domain, F.when(F.col("edge") | (F.col("middle") == 1), "dev").otherwise("holdout").alias("part"))


def gates(measures: DataFrame, least: dict[str, float]) -> DataFrame:
    """(passed, failed) of one row of measures: the names of those below their threshold or null."""
    failed = F.filter(F.array(*[F.when(F.coalesce(F.col(n) < t, F.lit(True)), F.lit(n)) for n, t in sorted(least.items())]), lambda x: x.isNotNull())
    return measures.select((F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed"))


def coverage(rows: DataFrame, key: list[str], classes: dict[str, list]) -> DataFrame:
    """One row: n, unique (no key twice) and, for each column, covered_<column>: whether each of its values occurs."""
    has = [F.size(F.array_except(F.array(*[F.lit(v) for v in values]), F.collect_set(c))).alias(f"missing_{c}") for c, values in classes.items()]
    one = rows.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*key)).alias("keys"), *has)
    return one.select("n", (F.col("n") == F.col("keys")).alias("unique"), *[(F.col(f"missing_{c}") == 0).alias(f"covered_{c}") for c in classes])


def overlapping(manifests: DataFrame) -> DataFrame:
    """(key, n) of keys that several manifests (manifest, key) name."""
    return manifests.distinct().groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
