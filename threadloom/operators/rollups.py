"""Rollups of chats, of stored results and of answers by dimension; all are aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chat_rollup(messages: DataFrame) -> DataFrame:
    """chat, n, n_expected, participants, topic, first_at of each chat.

    messages: chat, id, speaker, topic, at, expected. Participants stand in the order of their first
    message. The topic is the commonest, the smaller one on a tie, 'general' where none is given.
    A chat's rows are counted by speaker and by topic first, so a long chat is no task of its own.
    """
    place = F.struct("id", "at")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    speakers = messages.groupBy("chat", filled("speaker").alias("speaker")).agg(
        F.count("*").alias("n"), F.count_if(F.lower(F.col("expected").cast("string")) == "true").alias("k"), F.min("id").alias("first"), F.min(F.when(F.col("at").isNotNull(), place)).alias("at")
    )
    people = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("first", "speaker"))))
    chats = speakers.groupBy("chat").agg(F.sum("n").alias("n"), F.sum("k").alias("n_expected"), people.getField("speaker").alias("participants"), F.min("at").getField("at").alias("first_at"))
    topics = messages.filter("topic <> ''").groupBy("chat", "topic").agg(F.count("*").alias("m")).groupBy(F.col("chat").alias("c")).agg(F.min(F.struct(-F.col("m"), "topic")).getField("topic").alias("topic"))
    return chats.join(topics, F.col("chat").eqNullSafe(F.col("c")), "left").select("chat", "n", "n_expected", "participants", F.coalesce("topic", F.lit("general")).alias("topic"), "first_at")


def memo_stats(entries: DataFrame) -> DataFrame:
    """type, n, hits, oldest, newest of stored results (type, hits, created_at), with a row 'all'; no rows where nothing is stored."""
    by = entries.rollup("type").agg(F.grouping("type").alias("top"), F.count("*").alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    return by.filter("n > 0").select(F.when(F.col("top") == 1, "all").otherwise(F.col("type")).alias("type"), "n", "hits", "oldest", "newest")


def participant_ids(speaker: Column, references: Column) -> Column:
    """The sorted distinct ids of a message's speaker and of what it refers to: strings, or JSON objects with _id or, without that, id."""
    known = F.coalesce(references, F.array().cast("array<string>"))
    ids = F.transform(known, lambda r: F.when(F.ltrim(r).startswith("{"), F.coalesce(F.get_json_object(r, "$._id"), F.get_json_object(r, "$.id"))).otherwise(r))
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.when(speaker != "", speaker)), ids), lambda x: x.isNotNull())))


def dimension_accuracy(answers: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, n, correct, accuracy of answers (dimension, correct) for each of these dimensions and 'overall'; without an answer 0."""
    counts = answers.filter(F.col("dimension").isin(dimensions)).groupBy("dimension").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))
    asked = answers.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in dimensions])).alias("dimension"))
    full = asked.join(counts, "dimension", "left").select("dimension", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("correct", F.lit(0)).alias("correct"))
    both = full.unionByName(full.agg(F.lit("overall").alias("dimension"), F.sum("n").alias("n"), F.sum("correct").alias("correct")))
    return both.withColumn("accuracy", F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), 4)).otherwise(0.0))


def scenario_counts(lines: DataFrame) -> DataFrame:
    """scenario, n of lines (scenario); those without one count as 'unknown'."""
    return lines.groupBy(F.coalesce(F.when(F.col("scenario") != "", F.col("scenario")), F.lit("unknown")).alias("scenario")).agg(F.count("*").alias("n"))
