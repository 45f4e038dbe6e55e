"""Decisions, snapshots and graphs as files: readers and writers.

Decisions lie in folders project=.../topic=..., a Markdown file or a Parquet row for each version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.sources.messages import read_front_matter


def select_chats(messages: DataFrame, expected: DataFrame, chats: list[str] | None = None, sample: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The messages and expected rows of these chats, or of the first ``sample`` by name, or of all."""
    if chats is not None:
        keep = messages.sparkSession.createDataFrame([(c,) for c in sorted(set(chats))], "chat_id string")
    else:
        keep = messages.select("chat_id").distinct().orderBy("chat_id")
        keep = keep if sample is None else keep.limit(sample)
    return tuple(df.join(F.broadcast(keep) if chats is not None or sample is not None else keep, "chat_id", "left_semi") for df in (messages, expected))


def selection_hash(rows: DataFrame) -> str:
    """A hash of a table's rows whatever their order: the SHA-256 of the sum and number of their hashes."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    one = rows.select(digest.alias("h")).agg(F.sum("h").alias("s"), F.count("*").alias("n")).select(F.sha2(F.concat_ws(":", F.col("s").cast("string"), F.col("n").cast("string")), 256).alias("h"))
    return one.first()["h"]


def read_decisions(spark: SparkSession, path: str, project: str | None = None, topic: str | None = None) -> DataFrame:
    """(project, topic, fields, body) of the Markdown files below a folder, of one project or topic if asked."""
    found = read_front_matter(spark, f"{path}/project={project or '*'}/topic={topic or '*'}")
    part = lambda name: F.url_decode(F.regexp_extract("path", name + r"=([^/]*)", 1))
    return found.select(part("project").alias("project"), part("topic").alias("topic"), "fields", "body")


def listed_topics(spark: SparkSession, path: str, project: str) -> DataFrame:
    """The topics that have a folder in a project, in order."""
    return read_decisions(spark, path, project).select("topic").distinct().orderBy("topic")


def read_loose(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields) of files of ``key: value`` lines; other lines are passed over, of a repeated key the last counts."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(r"^\s*[A-Za-z_][\w ]*:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["k"] == p["k"]))
    return whole.select("path", F.map_from_entries(last).alias("fields"))


def write_markdown(rows: DataFrame, path: str) -> None:
    """Writes rows (project, topic, text) as text files below project=.../topic=..., a file for each row."""
    rows.select("project", "topic", "text").repartition("project", "topic").write.partitionBy("project", "topic").option("lineSep", "\u0000").mode("append").option("maxRecordsPerFile", 1).text(path)


def append_versions(decisions: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Appends decisions (sid, project, topic, ...) as their next versions to a table in ``path``, which may be empty or absent.

    Several rows of one sid are numbered by the columns ``order``, then by all others. The highest
    version is read before writing, so a table may have one writer at a time; two would give one version twice.
    """
    spark = decisions.sparkSession
    try:
        top = spark.read.parquet(path).groupBy("sid").agg(F.max("version").alias("top"))
    except Exception as e:  # only a table that doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        top = spark.createDataFrame([], "sid string, top long")
    own = F.row_number().over(W.partitionBy("sid").orderBy(*(order or []), *[c for c in decisions.columns if c != "sid" and c not in (order or [])]))
    rows = decisions.join(top, "sid", "left").withColumn("version", (own + F.coalesce("top", F.lit(0))).cast("long")).drop("top")
    rows.write.partitionBy("project", "topic").mode("append").parquet(path)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The last version of each decision, by aggregation."""
    return versions.groupBy("sid").agg(F.max_by(F.struct("*"), "version").alias("v")).select("v.*")


def archive_project(spark: SparkSession, path: str, archive: str, project: str) -> None:
    """Copies a project's versions to an archive, in which an earlier copy of it is replaced."""
    rows = spark.read.parquet(path).filter(F.col("project") == project)
    rows.write.partitionBy("project", "topic").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(archive)


def write_graph(path: str, **layers: DataFrame) -> None:
    """Writes each layer of a graph as a table of its own below ``path``."""
    for name, rows in layers.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, *layers: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in layers}


def snapshots(rows: DataFrame, most: int | None = None, source: str | None = None) -> DataFrame:
    """Snapshots (id, source, ts, ...), the newest first; the limit is taken before the source, as listings show it."""
    found = rows.orderBy(F.desc("ts"), "id")
    found = found if most is None else found.limit(most)
    return found if source is None else found.filter(F.col("source") == source)


def keep_newest_snapshots(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest snapshots of each source; the others are to be deleted."""
    w = W.partitionBy("source").orderBy(F.desc("ts"), "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def file_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(path, hash, size, modified) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change_type) of files that were created, modified or deleted between two snapshots."""
    both = before.select("path", F.col("hash").alias("old")).join(after.select("path", F.col("hash").alias("new")), "path", "full")
    kind = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", kind.alias("change_type")).filter("change_type IS NOT NULL")


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, added, removed): distinct lines that only the new or only the old text of a path (path, text) has."""
    lines = lambda c: F.array_distinct(F.split(F.coalesce(c, F.lit("")), "\n"))
    both = old.select("path", F.col("text").alias("o")).join(new.select("path", F.col("text").alias("n")), "path", "full")
    count = lambda a, b: F.size(F.array_except(lines(a), lines(b)))
    return both.select("path", count("n", "o").alias("added"), count("o", "n").alias("removed"))


def merged_ontology(default: DataFrame, custom: DataFrame, key: list[str]) -> DataFrame:
    """Definitions of both, the custom ones in place of default ones of the same key."""
    return custom.unionByName(default.join(custom.select(*key).distinct(), key, "left_anti"))
