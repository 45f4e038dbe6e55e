"""Retrieval for many queries at once: fusion of signals, fallback, resolution, reranking, groups, diversity, entity paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.vector import cosine
from threadloom.operators.likeness import bigram_sets, like_between, like_pairs
from threadloom.operators.search import nearest_each, top_each
from threadloom.sources.scratch import beside, written


def fused(signals: dict[str, DataFrame], most: int, k: int = 60) -> DataFrame:
    """(query_id, id, score, n_signals) from ranked signals (query_id, id, score), the ``most`` best of each query.

    With two signals or more that found something the score is the reciprocal rank fusion; a single
    one passes its own scores through. A signal's rows are taken as they come: cut them before.
    """
    names = list(signals)
    place = F.row_number().over(W.partitionBy("query_id", "signal").orderBy(F.desc("score"), "id"))
    tagged = reduce(DataFrame.unionByName, [df.select("query_id", "id", "score", F.lit(n).alias("signal")) for n, df in signals.items()]).withColumn("rank", place)
    heard = tagged.groupBy("query_id").agg(F.count_distinct("signal").alias("n_signals"))
    part = lambda n: F.coalesce(F.max(F.when(F.col("signal") == n, 1.0 / (k + F.col("rank")))), F.lit(0.0))
    rrf = tagged.groupBy("query_id", "id").agg(reduce(lambda a, b: a + b, [part(n) for n in names]).alias("rrf"), F.max("score").alias("own")).join(heard, "query_id")
    scored = rrf.select("query_id", "id", F.when(F.col("n_signals") > 1, F.col("rrf")).otherwise(F.col("own")).alias("score"), "n_signals")
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))).filter(F.col("place") <= most).drop("place")


def with_fallback(found: DataFrame, queries: DataFrame, rows: DataFrame, id_col: str, columns: list[str], most: int) -> DataFrame:
    """``found`` (query_id, id, score), and for queries (query_id, query) without any the rows that hold the query in a column, with score 0, by id.

    queries: as many as were asked, a stated set that is broadcast.
    """
    silent = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    text = F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns]))
    hits = rows.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(silent), F.contains("text", F.lower("query"))).select("query_id", "id", F.lit(0.0).alias("score"))
    return found.select("query_id", "id", "score").unionByName(top_each(hits, most).select("query_id", "id", "score"))


def resolved(found: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """(query_id, rank, score, and the columns of the decision) of found ids that exist, each once, by rank from 0."""
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    joined = best.join(decisions, F.col("id") == F.col(key))
    return joined.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")) - 1)


def reranked(found: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """``found`` in the order of a reranker's scores (query_id, id, score), those it doesn't know last with 0, cut to ``most``."""
    s = scores.select("query_id", "id", F.col("score").alias("new"))
    w = W.partitionBy("query_id").orderBy(F.desc("new"), "rank")
    again = found.join(s, ["query_id", "id"], "left").withColumn("new", F.coalesce("new", F.lit(0.0)))
    return again.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most).withColumn("score", F.col("new")).drop("new")


def grouped(found: DataFrame, topic: str, most: int) -> DataFrame:
    """``found`` with topic, topic_rank, place and matches: topics in the order of their first hit, of each the ``most`` best."""
    t = found.withColumn("topic", F.coalesce(F.nullif(F.col(topic).cast("string"), F.lit("")), F.lit("general")))
    by = W.partitionBy("query_id", "topic")
    t = t.withColumn("first", F.min("rank").over(by)).withColumn("matches", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy("rank")) - 1)
    return t.withColumn("topic_rank", F.dense_rank().over(W.partitionBy("query_id").orderBy("first")) - 1).filter(F.col("place") < most).drop("first")


def diverse(found: DataFrame, limit: float = 0.85) -> DataFrame:
    """(query_id, id, rank) of found rows (query_id, id, rank, vector; a few of each query), without those nearer than ``limit`` to one that stays."""
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "vector"))).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    keep = F.aggregate("rows", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda y: F.round(cosine(y["vector"], x["vector"]), 9) > limit), kept).otherwise(F.concat(kept, F.array(x))))
    return rows.select("query_id", F.explode(keep).alias("x")).select("query_id", "x.id", "x.rank")


def layered(queries: DataFrame, layers: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """(query_id, layer, id, score): the nearest rows (id, vector) of each layer to queries (id, vector), as many as the layer says; a row of the query's own id counts too."""
    found = []
    for name, (rows, most) in layers.items():
        near = nearest_each(rows, queries, most, itself=True)
        found.append(near.select("query_id", F.lit(name).alias("layer"), "id", "score"))
    return reduce(DataFrame.unionByName, found)


def centroids(rows: DataFrame, cluster: str, vector: str, unit: bool = False) -> DataFrame:
    """(cluster, n, vector): the mean vector of each cluster, of length 1 if ``unit``; one number for each cluster and dimension is shuffled."""
    cells = rows.select(cluster, F.posexplode(vector).alias("at", "x")).groupBy(cluster, "at").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    mean = cells.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("v"))
    if unit:
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
        mean = mean.withColumn("v", F.transform("v", lambda x: F.when(length > 0, x / length).otherwise(x)))
    return mean.select(F.col(cluster).alias("cluster"), "n", F.col("v").alias("vector"))


def query_entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name): names that a query holds, whatever the case. queries (query_id, query): a stated set that is broadcast."""
    return names.select("name").distinct().join(F.broadcast(queries), F.contains(F.lower("query"), F.lower("name"))).select("query_id", "name")


def by_entities(asked: DataFrame, mentions: DataFrame, references: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score): decisions on a path entity - source - decision from the names that queries ask for, 1 / (1 + rank) in order of how many names lead there.

    asked: (query_id, name); mentions: (source, name) of messages and documents; references: (id, source).
    """
    paths = mentions.join(beside(asked), "name").select("query_id", "name", "source").distinct().join(references, "source")
    found = paths.groupBy("query_id", "id").agg(F.count_distinct("name").alias("names"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("names"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "id", (1.0 / F.col("place")).alias("score"))


def nearest_in_topic(new: DataFrame, rows: DataFrame, most: int = 5, accept: float = 0.5, alike: float = 0.15) -> DataFrame:
    """(id, match, score, kind): for each new row (id, topic, vector, text) the nearest of the topic's others, if its cosine is over ``accept``.

    Else the first, by id, of those whose text shares ``alike`` of its bigrams, a number over 0.
    Vectors meet as matrix products within tasks, texts as classes of equal bigrams, so that copies meet once.
    """
    near = nearest_each(rows, new, most, within="topic").filter((F.col("rank0") == 0) & (F.col("score") > accept))
    best = written(near.select(F.col("query_id").alias("new"), F.col("id").alias("match"), "score", F.lit("vector").alias("kind")))
    asked = written(bigram_sets(new.join(best.select(F.col("new").alias("id")), "id", "left_anti"), "id", "topic", "text"))
    kinds = asked.groupBy("block", "grams").agg(F.min("id").alias("kind"))
    # a class counts by its two first ids, as a row is not like itself
    place = lambda *key: F.row_number().over(W.partitionBy(*key).orderBy("id"))
    firsts = bigram_sets(rows, "id", "topic", "text").withColumn("place", place("block", "grams")).filter("place <= 2")
    firsts = written(firsts.groupBy("block", "grams").agg(F.min("id").alias("class"), F.collect_set("id").alias("ids")))
    pairs = like_between(kinds.select("block", F.col("kind").alias("id"), "grams"), firsts.select("block", F.col("class").alias("id"), "grams"), alike - 1e-9)
    pairs = pairs.select("block", F.col("id").alias("kind"), F.col("other").alias("class"), F.round("similarity", 9).alias("score")).filter(F.col("score") >= alike)
    met = pairs.join(firsts.drop("grams"), ["block", "class"]).select("block", "kind", "score", F.explode("ids").alias("id"))
    met = met.withColumn("place", place("block", "kind")).filter("place <= 2").drop("place")
    own = asked.select("block", "grams", F.col("id").alias("new")).join(kinds, ["block", "grams"]).select("block", "kind", "new")
    first = own.join(met, ["block", "kind"]).filter("id <> new").groupBy("new").agg(F.min(F.struct("id", "score")).alias("f"))
    return best.unionByName(first.select("new", F.col("f.id").alias("match"), "f.score", F.lit("text").alias("kind"))).withColumnRenamed("new", "id")


def similar_new(new: DataFrame, rows: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, match, similarity): rows of a new row's topic whose summaries, or texts where one has none, are alike; ``least`` is over 0."""
    said = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.col("full_text"))
    sets = lambda df: bigram_sets(df.select("id", "topic", said.alias("said")), "id", "topic", "said")
    pairs = like_between(sets(new), sets(rows), least - 1e-9).filter("id <> other")
    return pairs.select("id", F.col("other").alias("match"), F.round("similarity", 9).alias("similarity")).filter(F.col("similarity") >= least)


def across_chats(rows: DataFrame, topic_least: float = 0.5, least: float = 0.35) -> DataFrame:
    """(id_a, id_b, similarity): rows (id, chat, topic, summary) of different chats whose topics' names and whose summaries are alike.

    Topics are compared once; rows then meet within a pair of like topics.
    """
    topics = bigram_sets(rows.filter("topic <> ''").select("topic").distinct().select(F.lit(0).alias("all"), "topic"), "topic", "all", "topic")
    pairs = like_pairs(topics, topic_least).select(F.concat_ws("|", "id_a", "id_b").alias("block"), F.explode(F.array("id_a", "id_b")).alias("topic"))
    pairs = pairs.unionByName(topics.select(F.col("id").alias("block"), F.col("id").alias("topic")))
    sets = bigram_sets(rows.join(pairs, "topic").select("block", F.struct("id", "chat", "topic").alias("id"), "summary"), "id", "block", "summary")
    both = like_pairs(sets, least).filter("id_a.chat <> id_b.chat AND (NOT contains(block, '|') OR id_a.topic <> id_b.topic)")
    a, b = F.col("id_a.id"), F.col("id_b.id")
    return both.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"), F.round("similarity", 9).alias("similarity")).distinct()
