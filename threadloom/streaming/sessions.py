"""Sessions of a message stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(messages: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """(key, begin, last, n) of sessions that end after ``gap`` without a message; works on batches too.

    ``late`` is None where the stream has a watermark.
    """
    source = messages.withWatermark(ts, late) if messages.isStreaming and late else messages
    found = source.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return found.select(key, F.col("w.start").alias("begin"), "last", "n")


def first_seen(messages: DataFrame, ids: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each message once, however often it is delivered within the watermark."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids) if messages.isStreaming else messages.dropDuplicates(ids)
