"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, as in tests on one machine, a temporary one.

    On a cluster without that setting no folder is shared, so this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that is written once and read from there, so that its plan ends here."""
    path = posixpath.join(shared_folder(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to as many tasks as can run at once, if it has fewer: work that is heavy for its bytes, read from few files."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


#: Rows of a side that is broadcast.
BROADCAST_ROWS = 100_000


def beside(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if it has at most BROADCAST_ROWS rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
