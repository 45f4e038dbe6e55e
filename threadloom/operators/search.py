"""Keyword, BM25 and dense search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions.text import search_tokens
from threadloom.functions.vector import cosine
from threadloom.sources.scratch import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Queries that are broadcast at once, and scores that a task holds at once.
QUERIES_PER_PASS, SCORES_AT_ONCE = 1024, 1 << 18


def keyword_search(df: DataFrame, query: str, columns: list[str], active: Column | None = None) -> DataFrame:
    """Rows that hold the query in one of the columns, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(query.lower()))
    return df.filter(found if active is None else found & active)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """(id, score) of the documents that hold a term of the query, scored by Okapi BM25."""
    return bm25_each(docs, {0: query}, id_col, text_col).select("id", "score")


def query_terms(query: str) -> list[str]:
    """The terms of a query, by the rule of ``search_tokens``."""
    return re.findall(r"\w{2,}", query.lower())


def bm25_each(docs: DataFrame, queries: dict[int, str], id_col: str, text_col: str) -> DataFrame:
    """(query_id, id, score) of the documents that hold a term of a query, scored by Okapi BM25.

    Texts are tokenised once, into a table of their lengths and the counts of the queries' terms;
    the document frequencies are one row per term, and the number and mean length of documents one
    row. A term in over half of the documents gets EPSILON times the mean idf of its query's terms
    instead of a negative one.
    """
    wanted = sorted({(k, w) for k, query in queries.items() for w in query_terms(query)})
    terms = sorted({w for _, w in wanted})
    asked = docs.sparkSession.createDataFrame(wanted, "query_id int, term string")
    hits = F.filter("t", lambda x: x.isin(terms))
    counted = docs.select(F.col(id_col).alias("id"), search_tokens(F.col(text_col)).alias("t")).select("id", F.size("t").alias("len"), hits.alias("t"))
    tf = F.transform(F.array_distinct("t"), lambda w: F.struct(w.alias("term"), F.size(F.filter("t", lambda x: x == w)).cast("long").alias("tf")))
    counted = written(counted.select("id", "len", tf.alias("t")))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    postings = counted.select("id", "len", F.explode("t").alias("p")).select("id", "len", "p.*")
    df = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))  # a row per query term, times one row
    idf = df.select("term", "mean", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")).join(F.broadcast(asked), "term")
    floor = idf.groupBy("query_id").agg((EPSILON * F.avg("idf")).alias("floor"))
    idf = idf.join(F.broadcast(floor), "query_id").select("query_id", "term", "mean", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = postings.join(F.broadcast(idf), "term").groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("p")))).alias("parts"))
    # terms are added in one order, so that the sum doesn't hang on the partitioning
    return scored.select("query_id", "id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["p"]).alias("score"))


def dense(vectors: DataFrame, probe: list[float], id_col: str, vector_col: str) -> DataFrame:
    """(id, score): cosine to one vector."""
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in probe])).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ties by id."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def top_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, id, score, rank0) of each query, ties by id. Tasks keep their own k best before rows are dealt."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("query_id", "id", "score", (F.col("place") - 1).alias("rank0"))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows (rows, queries); 0 where a norm is 0."""
    length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)
    return np.divide(x @ q.T, length, out=np.zeros(length.shape), where=length > 0)


def nearness(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The negative distances of single values (rows, queries)."""
    return -np.abs(x - q.T)


def better(ids: np.ndarray, best: np.ndarray, here: np.ndarray | slice, s: np.ndarray, own: np.ndarray) -> None:
    """Puts the scores (queries, rows) of rows ``own`` into the k best (queries, k) of queries ``here``, ties by id.

    Only scores that reach a query's last place are sorted, so that little but them is held.
    """
    at = np.arange(len(best))[here]
    q, r = np.nonzero((s >= best[at, -1:]) & (s > -np.inf))
    if not len(q):
        return
    of = np.unique(q)
    k, mine = best.shape[1], at[of]
    place = np.concatenate([np.repeat(np.arange(len(of)), k), np.searchsorted(of, q)])
    i, b = np.concatenate([ids[mine].ravel(), own[r]]), np.concatenate([best[mine].ravel(), s[q, r]])
    order = np.lexsort((i, -b, place))
    begins = np.searchsorted(place[order], np.arange(len(of)))
    first = order[(begins[:, None] + np.arange(k)).ravel()]  # each has k at least, those of before
    ids[mine], best[mine] = i[first].reshape(-1, k), b[first].reshape(-1, k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray] = cosines, itself: bool = False, within: str | None = None) -> DataFrame:
    """The k best (query_id, id, score, rank0) of each query among all rows, but for the one of its own id unless ``itself``, scores to 9 places, ties by id.

    rows, queries: (id, vector). Queries are broadcast in blocks of QUERIES_PER_PASS; a task
    scores its rows against a block and keeps its k best for each query. Rows and queries of a
    null id or vector take no part. ``within``: a column of both; only rows of a query's own value
    are scored, and those of null take no part.
    """
    group = F.lit("") if within is None else F.col(within).cast("string")
    known = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), group.alias("group")).dropna()
    spark, found, part = rows.sparkSession, [], []

    def one_pass(block: list) -> DataFrame:
        names = sorted({r["group"] for r in block})
        places = {g: np.array([n for n, r in enumerate(block) if r["group"] == g]) for g in names} if within else {"": slice(None)}
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64), np.array([r["vector"] for r in block], float), pa.array(names, pa.string()), [places[g] for g in names]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, q, names, places = shared.value
            ids, best = np.zeros((len(asked), k), np.int64), np.full((len(asked), k), -np.inf)
            step = max(1, SCORES_AT_ONCE // max(1, len(asked)))
            for batch in batches:
                for at in range(0, len(batch), step):
                    mine, vectors = batch.column(0)[at : at + step].to_numpy(), batch.column(1)[at : at + step]
                    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1)
                    of = pc.index_in(batch.column(2)[at : at + step], names).fill_null(-1).to_numpy()
                    for g in np.unique(of[of >= 0]):
                        own, here = mine[of == g], places[g]
                        s = np.round(score(x[of == g], q[here]), 9).T
                        if not itself:
                            s[own == asked[here][:, None]] = -np.inf
                        better(ids, best, here, s, own)
            some = best > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked[:, None], ids.shape)[some]), pa.array(ids[some]), pa.array(best[some])], names=["query_id", "id", "score"])

        return known(rows).mapInArrow(run, "query_id long, id long, score double")

    for r in known(queries).orderBy("id").toLocalIterator():  # a block of queries at a time
        part.append(r)
        if len(part) >= QUERIES_PER_PASS:
            found.append(one_pass(part))
            part = []
    if part or not found:
        found.append(one_pass(part) if part else rows.limit(0).select(F.lit(0).cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), F.lit(0.0).alias("score")))
    return top_each(reduce(DataFrame.unionByName, found), k)
