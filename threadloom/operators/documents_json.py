"""JSON of unknown shape as VARIANT: its leaves, with times told by the names of fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of fields that hold times, names that don't though they look so, and endings of those that do.
TIME_FIELDS = [
    "timestamp", "createTime", "updateTime", "create_time", "update_time", "sent_timestamp", "received_timestamp", "create_timestamp", "last_update_timestamp",
    "modify_timestamp", "readUpdateTime", "created_at", "updated_at", "joinTime", "leaveTime", "lastOnlineTime", "sync_time", "processed_at",
    "start_time", "end_time", "event_time", "build_timestamp", "datetime", "created", "updated",
]
OTHER_FIELDS = [
    "runtime", "timeout", "timeline", "timestamp_format", "time_zone", "time_limit", "timestamp_count", "timestamp_enabled", "time_sync",
    "playtime", "lifetime", "uptime", "downtime",
]
TIME_ENDINGS = ["_time", "_timestamp", "_at", "_date"]
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"


def is_time_field(name: Column) -> Column:
    """Whether a field of this name holds a time."""
    low = F.lower(name)
    known = name.isin(TIME_FIELDS) | low.isin(TIME_FIELDS)
    other = name.isin(OTHER_FIELDS) | low.isin(OTHER_FIELDS)
    ends = low.rlike("(" + "|".join(TIME_ENDINGS) + ")$") | name.rlike("(Time|Timestamp)$")
    return F.coalesce(known | (~other & ends), F.lit(False))


def leaves(rows: DataFrame, id_col: str, json: str, most: int = 64) -> DataFrame:
    """(id_col, path, field, kind, value, at, error): every value in the JSON of each row that holds no other, with its path ('$.a[0].b').

    ``kind`` is its type in Spark's words (STRING, BIGINT, ...; VOID for null; OBJECT<> and ARRAY<> for empty ones) and
    ``value`` its text. A string whose nearest field is named like a time and that looks like
    an ISO time has it in ``at``, in UTC if it names no zone; at is null where it can't be read. A row whose text is no JSON has
    one row, with ``error``; a null text has none. Nesting beyond ``most`` levels raises.
    """
    parsed = rows.filter(F.col(json).isNotNull()).select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json)).alias("v"), F.col(json).alias("text"))
    bad = parsed.filter("v IS NULL").select("id", F.lit("$").alias("path"), F.lit("").alias("field"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp").alias("at"), F.concat(F.lit("no JSON: "), F.substring("text", 1, 80)).alias("error"))
    level = parsed.filter("v IS NOT NULL").select("id", F.lit("$").alias("path"), F.lit("").alias("field"), "v")
    spark, found = rows.sparkSession, []
    for _ in range(most):
        typed = level.withColumn("kind", F.schema_of_variant("v"))
        nested = (F.col("kind").startswith("OBJECT<") | F.col("kind").startswith("ARRAY<")) & ~F.col("kind").isin("OBJECT<>", "ARRAY<>", "ARRAY<VOID>")
        # an array of nulls has elements too; an empty one has the same schema, so both are told by their text
        nested = nested | ((F.col("kind") == "ARRAY<VOID>") & (F.to_json("v") != "[]"))
        found.append(typed.filter(~nested).select("id", "path", "field", "kind", F.when(F.col("kind").isin("OBJECT<>", "ARRAY<>", "ARRAY<VOID>"), F.to_json("v")).otherwise(F.try_variant_get("v", "$", "string")).alias("value")))
        deeper = typed.filter(nested)
        if deeper.isEmpty():
            break
        inside = deeper.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("pos", F.col("key").alias("k"), F.col("value").alias("x")))
        step = F.when(F.col("k").isNotNull(), F.concat(F.lit("."), "k")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = inside.select("id", F.concat("path", step).alias("path"), F.coalesce("k", "field").alias("field"), F.col("x").alias("v"))
    else:
        raise ValueError(f"JSON is nested more than {most} levels deep")
    good = reduce(DataFrame.unionByName, found)
    told = (F.col("kind") == "STRING") & is_time_field(F.col("field")) & F.col("value").rlike(ISO)
    good = good.withColumn("at", F.when(told, F.try_to_timestamp("value"))).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(bad).withColumnRenamed("id", id_col)
