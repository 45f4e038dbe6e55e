"""Decisions, relations and messages as the queries take them from the driver's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import status as S


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark, sf_dir):
    """A decision for each order."""
    k = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    s = lambda x: x.cast("string")
    up = F.floor(k / 7)
    return read(spark, sf_dir, "orders").select(
        k.alias("n"),
        F.concat(F.lit("d"), s(k)).alias("sid"),
        F.concat(F.lit("p"), s(k % 3)).alias("project"),
        F.when(k % 17 == 0, "").otherwise(F.col("o_orderpriority")).alias("topic_id"),
        pick(S.STATUSES).alias("status"),
        pick(S.IMPACTS).alias("impact_level"),
        F.concat(F.lit("title "), s(k % 50)).alias("title"),
        F.concat(F.lit("Use option "), s(k % 500), F.lit(" for "), F.col("o_orderpriority")).alias("summary"),
        F.concat(F.lit("order "), s(k), F.lit(" of customer "), s(F.col("o_custkey"))).alias("full_text"),
        F.when((k % 7 == 0) | (up == 0), "").otherwise(F.concat(F.lit("d"), s(up))).alias("parent_id"),
        ((k * 37 % 1000) / 10.0).alias("hot_score"),
        ((k * 13 % 100) / 100.0).alias("confidence"),
        (k % 12 + 1).alias("version"),
        F.concat(F.lit("c"), s(F.col("o_custkey") % 20)).alias("chat_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def relations(spark, sf_dir):
    """A relation for every other order, some to decisions that don't exist."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(v) for v in S.RELATIONS]), (F.floor(k / 2) % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").filter(k % 2 == 0).select(F.concat(F.lit("d"), k.cast("string")).alias("src"), kind.alias("type"), F.concat(F.lit("d"), (k * 31 % 20000).cast("string")).alias("dst"))


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same tables as CTEs.
DECISIONS = f"""d AS (SELECT o_orderkey AS n, 'd' || o_orderkey AS sid, 'p' || (o_orderkey % 3) AS project, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE o_orderpriority END AS topic_id,
{sql_list(S.STATUSES)}[o_orderkey % 10 + 1] AS status, {sql_list(S.IMPACTS)}[o_orderkey % 4 + 1] AS impact_level, 'title ' || (o_orderkey % 50) AS title,
'Use option ' || (o_orderkey % 500) || ' for ' || o_orderpriority AS summary, 'order ' || o_orderkey || ' of customer ' || o_custkey AS full_text,
CASE WHEN o_orderkey % 7 = 0 OR o_orderkey < 7 THEN '' ELSE 'd' || (o_orderkey // 7) END AS parent_id, CAST((o_orderkey * 37 % 1000) / 10.0 AS DOUBLE) AS hot_score,
CAST((o_orderkey * 13 % 100) / 100.0 AS DOUBLE) AS confidence, o_orderkey % 12 + 1 AS version, 'c' || (o_custkey % 20) AS chat_id, o_orderdate AS created_at FROM orders)"""
RELATIONS = f"""r AS (SELECT 'd' || o_orderkey AS src, {sql_list(S.RELATIONS)}[(o_orderkey // 2) % 6 + 1] AS type, 'd' || (o_orderkey * 31 % 20000) AS dst FROM orders WHERE o_orderkey % 2 = 0)"""
ACTIVE = "status IN (" + ", ".join(f"'{s}'" for s in S.ACTIVE) + ")"
TOPIC = "CASE WHEN coalesce(topic_id, '') = '' THEN 'general' ELSE topic_id END"
