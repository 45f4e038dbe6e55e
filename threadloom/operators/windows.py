"""Order within a conversation: gaps, sessions, segments, retention, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, key: str, ts: str, order: list[str], seconds: float) -> DataFrame:
    """All columns with gap (seconds since the row before) and session (from 0 in each key)."""
    w = W.partitionBy(key).orderBy(ts, *order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return df.withColumn("gap", gap / 1e6).withColumn("session", F.sum(F.when(F.col("gap") >= seconds, 1).otherwise(0)).over(w))


def segments(df: DataFrame, key: str, order: list[str], topic: str, alone: str | None = None) -> DataFrame:
    """All columns with segment, which grows by one wherever the topic isn't that of the row before, and around rows that ``alone`` marks."""
    w = W.partitionBy(key).orderBy(*order)
    same = F.lag(topic).over(w).eqNullSafe(F.col(topic))
    if alone is not None:
        same = same & ~F.coalesce(F.col(alone), F.lit(False)) & ~F.coalesce(F.lag(alone).over(w), F.lit(False))
    new = F.when(same, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def keep_last(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def within_budget(df: DataFrame, key: str, order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows of each key while the cost of the rows before them is under the budget."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("spent", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("spent") < budget)


def gap_bucket(gap):
    """A name for the time since the message before."""
    return F.when(gap.isNull(), "first").when(gap < 0, "negative").when(gap < 60, "minute").when(gap < 3600, "hour").when(gap < 86400, "day").otherwise("longer")
