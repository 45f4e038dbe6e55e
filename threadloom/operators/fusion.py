"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked(df: DataFrame, id_col: str, score_col: str, top_n: int) -> DataFrame:
    """The best ``top_n`` rows as (id, rank0), ties by id.

    Only the bounded top-n goes through the one-task ranking window.
    """
    from pyspark.sql import Window as W

    best = df.select(F.col(id_col).alias("id"), F.col(score_col).alias("score")).orderBy(F.desc("score"), "id").limit(top_n)
    return best.select("id", (F.row_number().over(W.orderBy(F.desc("score"), "id")) - 1).alias("rank0"))


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank0 + 1) over the named (id, rank0) lists.

    Parts are pivoted and added in the order of the lists, so that the sum is the
    same whatever the partitioning.
    """
    tagged = reduce(DataFrame.unionByName, [df.select("id", "rank0", F.lit(name).alias("signal")) for name, df in lists.items()])
    parts = [F.coalesce(F.max(F.when(F.col("signal") == name, 1.0 / (k + F.col("rank0") + 1))), F.lit(0.0)) for name in lists]
    return tagged.groupBy("id").agg(reduce(lambda a, b: a + b, parts).alias("score"))
