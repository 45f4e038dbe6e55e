"""Exact values at given ranks, found by histograms that narrow to them; no group is sorted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.scratch import written

#: Bins of a histogram.
BINS = 256
#: Targets that are broadcast to the values; more are joined by a shuffle.
BROADCAST_TARGETS = 50_000


def _beside(values: DataFrame, targets: DataFrame) -> DataFrame:
    return F.broadcast(targets) if targets.count() <= BROADCAST_TARGETS else targets


def values_at(values: DataFrame, key: str, value: str, targets: DataFrame) -> DataFrame:
    """(key, rank, value as double) of each target (key, rank): the value at that place, from 0, among the key's values in ascending order.

    Nulls and NaNs aren't counted. A rank below 0 or beyond the last value gives no row, and so do null keys.
    Each round counts the values of a target's range in BINS bins and goes on in the one that
    holds the rank, between the least and largest value found there, until these are equal:
    the rounds grow with the digits of the values, not with their number.
    """
    v = values.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).filter("_k IS NOT NULL AND _v IS NOT NULL AND NOT isnan(_v)")
    sizes = v.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    wanted = targets.select(F.col(key).alias("_k"), F.col("rank").cast("long").alias("rank")).distinct()
    open_ = written(wanted.join(sizes, "_k").filter("rank >= 0 AND rank < n").select("_k", "rank", F.col("rank").alias("left"), "lo", "hi"))
    done = []
    while True:
        done.append(open_.filter("lo = hi").select("_k", "rank", F.col("lo").alias("v")))
        left = open_.filter("lo < hi")
        if left.isEmpty():
            break
        met = v.join(_beside(v, left), "_k").filter("_v BETWEEN lo AND hi")
        # halves keep the difference of two large numbers finite; the largest value has a bin of its own, so that each round narrows
        share = F.coalesce(F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0))
        place = F.when(F.col("_v") == F.col("hi"), F.lit(BINS).cast("long")).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = met.groupBy("_k", "rank", "left", place.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        # at most BINS + 1 rows for a target
        each = bins.groupBy("_k", "rank", "left").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "lo", "hi"))).alias("b"))
        start = F.struct(F.col("left").alias("left"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
        step = lambda s, x: F.when(s["lo"].isNotNull(), s).when(s["left"] < x["n"], F.struct(s["left"].alias("left"), x["lo"].alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct((s["left"] - x["n"]).alias("left"), s["lo"].alias("lo"), s["hi"].alias("hi")))
        open_ = written(each.select("_k", "rank", F.aggregate("b", start, step).alias("s")).select("_k", "rank", "s.*"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("_k").alias(key), "rank", F.col("v").alias(value))
