"""Texts that are alike, within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.likeness import bigram_sets, like_counts, like_pairs
from threadloom.sources.scratch import written


def fuzzy_pairs(df: DataFrame, id_col: str, block: str, text: str, least: float) -> DataFrame:
    """(block, id_a, id_b, similarity): pairs of one block whose texts' bigram sets reach a Jaccard similarity, id_a < id_b.

    A pair that comes from copies of a text comes for each copy; where copies are many, take ``similar_classes``.
    """
    return like_pairs(bigram_sets(df, id_col, block, text), least)


def _classes(df: DataFrame, id_col: str, block: str, text: str) -> DataFrame:
    sets = bigram_sets(df, id_col, block, text)
    return written(sets.groupBy("block", "grams").agg(F.min("id").alias("id"), F.count("*").alias("rows")))


def similar_classes(df: DataFrame, id_col: str, block: str, text: str, least: float) -> DataFrame:
    """(block, class_id, n, links): rows of equal bigram sets are a class, named by its smallest id, with its number of rows and of other classes it is like.

    Copies are put together first, so a group of them makes no pairs; links are between classes
    and are counted where they are found.
    """
    classes = _classes(df, id_col, block, text)
    links = like_counts(classes.select("block", "id", "grams"), least)
    return classes.join(links, ["block", "id"], "left").select("block", F.col("id").alias("class_id"), F.col("rows").alias("n"), F.coalesce("links", F.lit(0)).alias("links"))


def similar_class_pairs(df: DataFrame, id_col: str, block: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (block, id_a, id_b, similarity) of classes of equal bigram sets, and the classes (block, class_id, n)."""
    classes = _classes(df, id_col, block, text)
    return like_pairs(classes.select("block", "id", "grams"), least), classes.select("block", F.col("id").alias("class_id"), F.col("rows").alias("n"))
