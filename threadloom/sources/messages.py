"""Readers of messages, ground truth and Markdown records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A .json file (a list), .jsonl, or else text lines ``[msg_id] speaker: text``."""
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).json(path)
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    pattern = r"^\[([^\]]+)\]\s*([^:：]+)[:：]\s*(.+)$"
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value").rlike(pattern))  # other lines are no messages
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(("msg_id", "speaker", "msg"))])


def expected_rows(truth: DataFrame) -> DataFrame:
    """Rows that expect a decision; those that don't say count as such."""
    return truth.filter(F.coalesce(F.col("expected_decision"), F.lit(True))) if "expected_decision" in truth.columns else truth


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields, body) of Markdown files: ``key: value`` lines between two lines of ``---``, then the body."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head, pattern = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z", 1), r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: F.instr(x, ":") > 0)
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))))))
    return whole.select("path", fields.alias("fields"), F.when(head == "", F.col("value")).otherwise(F.regexp_extract("value", pattern, 2)).alias("body"))
