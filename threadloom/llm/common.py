"""What several operators share: words as a Spark expression, tables, checkpoints."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that parts words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch that goes to Python. Batches of whole texts are held several times over, by the JVM and by Python.
BATCH_ROWS = 1000


def lean(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows, unless the session has been given another number than Spark's own 10,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def row_key() -> Column:
    """A hash of 64 bits of a row's doc_id, which may be null, and its text: what tells rows apart where an id doesn't.

    Rows that repeat both share it. Two of n other rows share it with a probability of n * n / 2**65.
    """
    return F.xxhash64("doc_id", "text")


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"{name}_{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's spark.checkpoint.dir alone; where it is unset, as in tests on one machine, take a temporary folder.

    On a cluster without that setting no folder is shared, so this raises.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the one of checkpoints."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written as a table to the shared checkpoint folder and read from there, so its lineage is cut.

    Unlike rows of a checkpointed RDD, the table is compressed, read by column and its size known.
    """
    spark = df.sparkSession
    path = posixpath.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value: object) -> Broadcast[bytes]:
    """A broadcast of a value whose classes executors needn't have: read it with pickle.loads."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
