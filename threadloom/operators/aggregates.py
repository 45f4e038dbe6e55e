"""Rollups and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scores import precision_recall_f1


def keyword_frequency(df: DataFrame, text: str, most: int) -> DataFrame:
    """(word, n): the commonest white-space words of two characters or more, ties by word."""
    words = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")).alias("word")).filter(F.length("word") >= 2)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def best_by(df: DataFrame, key: list[str], score: Column, order: Column) -> DataFrame:
    """One row of each key: the highest score, the first in order among equals."""
    return df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(score, -order)).alias("_best")).select("_best.*")


def group_scores(judged: DataFrame, by: list[str]) -> DataFrame:
    """Counts, precision, recall and F1 of each group from boolean ``expected`` and ``found``."""
    counts = judged.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.expr("expected AND found")), ("fp", F.expr("NOT expected AND found")), ("fn", F.expr("expected AND NOT found")))])
    return counts.select("*", *[c.alias(n) for n, c in precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def confusion(judged: DataFrame, expected: str, found: str, classes: list) -> DataFrame:
    """A row for each expected class with a count for each class found."""
    return judged.groupBy(F.col(expected).alias("expected")).agg(*[F.count_if(F.col(found) == c).alias(f"found_{c}") for c in classes])


def majority(votes: DataFrame, key: list[str], vote: str) -> DataFrame:
    """The value that over half of a key's rows have; null where none has."""
    counts = votes.groupBy(*key, vote).agg(F.count("*").alias("_n")).groupBy(*key).agg(F.sum("_n").alias("votes"), F.max(F.struct("_n", vote)).alias("_top"))
    return counts.select(*key, "votes", F.when(2 * F.col("_top._n") > F.col("votes"), F.col(f"_top.{vote}")).alias("winner"))


def keep_newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version of each key."""
    return df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")
