"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.vector import cosine
from threadloom.operators import retrieval, search
from threadloom.operators.fusion import ranked, reciprocal_rank_fusion
from threadloom.plans.base import read
from threadloom.plans.text_queries import TEXTS


def hybrid_topk(spark, sf_dir):
    """Dense and scalar signals for vector 0, fused by reciprocal rank; the 20 best."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    probe = vectors.filter("vec_id = 0").select(F.col("embedding").alias("probe"), F.col("label").alias("probe_label"))
    scored = vectors.filter("vec_id <> 0").crossJoin(F.broadcast(probe))
    dense = scored.select("vec_id", F.round(cosine(F.col("embedding"), F.col("probe")), 9).alias("score"))
    scalar = scored.select("vec_id", (-F.abs(F.col("label") - F.col("probe_label"))).cast("double").alias("score"))
    fused = reciprocal_rank_fusion({"dense": ranked(dense, "vec_id", "score", 60), "scalar": ranked(scalar, "vec_id", "score", 60)})
    return fused.select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20).join(vectors.select("vec_id", "label"), "vec_id")


def hybrid_topk_each(spark, sf_dir):
    """Dense and scalar signals for each vector whose id is divisible by 50, against all vectors, fused by reciprocal rank; the 20 best of each."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dense = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    scalar = vectors.select(F.col("vec_id").alias("id"), F.when(F.col("label").isNotNull(), F.array("label")).alias("vector"))
    lists = {"dense": search.nearest_each(dense, dense.filter("id % 50 = 0"), 60), "scalar": search.nearest_each(scalar, scalar.filter("id % 50 = 0"), 60, search.nearness)}
    lists = {name: found.select(F.struct("query_id", "id").alias("id"), "rank0") for name, found in lists.items()}
    fused = reciprocal_rank_fusion(lists).select("id.query_id", "id.id", F.round("score", 9).alias("score"))
    return search.top_each(fused, 20).select("query_id", F.col("id").alias("vec_id"), "score")


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("topic"))


def _queries(spark, sf_dir):
    """A query for each vector whose id is divisible by 50: (query_id, text), the number of one of TEXTS in turn."""
    ids = read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    return ids.withColumn("text", (F.col("query_id") / 50 % len(TEXTS)).cast("int"))


def _signals(spark, sf_dir):
    """The dense signal of each query's vector, but where its text is the third, and that of its words, but where it is the fourth."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = _queries(spark, sf_dir)
    dense = search.nearest_each(vectors, vectors.join(asked.filter("text <> 2").select(F.col("query_id").alias("id")), "id", "left_semi"), 30, itself=True).select("query_id", "id", "score")
    words = search.bm25_each(read(spark, sf_dir, "documents"), dict(enumerate(TEXTS)), "doc_id", "text").withColumn("score", F.round("score", 6)).filter("score > 0 AND query_id <> 3")
    best = search.top_each(words, 30).select(F.col("query_id").alias("text"), "id", "score")
    return {"dense": dense, "words": asked.join(best, "text").select("query_id", "id", "score")}


def retrieve(spark, sf_dir):
    """Both signals for each query, fused or passed through, with a keyword fallback, resolved and grouped by topic."""
    found = retrieval.fused(_signals(spark, sf_dir), 50)
    texts = F.array(*[F.lit(t) for t in TEXTS])
    queries = _queries(spark, sf_dir).select("query_id", F.get(texts, F.col("text")).alias("query")).unionByName(spark.createDataFrame([(-1, "oken =")], "query_id long, query string"))
    found = retrieval.with_fallback(found, queries, read(spark, sf_dir, "documents"), "doc_id", ["text", "source"], 50)
    groups = retrieval.grouped(retrieval.resolved(found, _documents(spark, sf_dir), "doc_id"), "topic", 10)
    return groups.select("query_id", "topic", F.col("topic_rank").cast("long").alias("topic_rank"), F.col("place").cast("long").alias("place"), "matches", "doc_id", F.round("score", 9).alias("score"))


def retrieve_reranked(spark, sf_dir):
    """The same before grouping, in the order of another score."""
    found = retrieval.resolved(retrieval.fused(_signals(spark, sf_dir), 50), _documents(spark, sf_dir), "doc_id")
    scores = found.filter("id % 3 > 0").select("query_id", "id", (F.col("id") * 7919 % 1009 / 1009.0).alias("score"))
    return retrieval.reranked(found, scores, 15).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def diverse_topk(spark, sf_dir):
    """The nearest vectors of each whose id is divisible by 50, without those near to one before."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = search.nearest_each(v, v.filter("id % 50 = 0"), 20).join(v, "id").select("query_id", "id", F.col("rank0").alias("rank"), "vector")
    return retrieval.diverse(found, 0.3).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


def layered_topk(spark, sf_dir):
    """The nearest labels, by their mean vectors, and the nearest vectors of each vector whose id is divisible by 50."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    topics = retrieval.centroids(v, "label", "vector").select(F.col("cluster").alias("id"), "vector")
    return retrieval.layered(v.filter("id % 50 = 0"), {"topic": (topics, 5), "episode": (v.select("id", "vector"), 10)})


def label_centroids(spark, sf_dir):
    """The mean vector of each label."""
    v = read(spark, sf_dir, "embeddings")
    return retrieval.centroids(v, "label", "embedding", unit=True).select("cluster", "n", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


def entity_paths(spark, sf_dir):
    """Orders on a path from the parts that questions name, over the line items that mention them."""
    parts = read(spark, sf_dir, "part").select(F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit(".")).alias("name"), "p_partkey")
    queries = spark.createDataFrame([(1, "What of Part 7. and part 12.?"), (2, "part 100. and part 7."), (3, "nothing")], "query_id int, query string")
    mentions = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("source"), "name")
    references = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 2))).alias("source"))
    found = retrieval.by_entities(retrieval.query_entities(queries, parts), mentions, references, 30)
    return found.select("query_id", "id", F.round("score", 9).alias("score"))


def nearest_in_topic(spark, sf_dir):
    """For each vector whose id is divisible by 50 its nearest of the same label, or one of a like text."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("topic"), F.col("embedding").alias("vector"), F.concat(F.lit("text "), (F.col("vec_id") % 30).cast("string"), F.lit(" of it")).alias("text"))
    return retrieval.nearest_in_topic(v.filter("id % 50 = 0"), v, 5, 0.25)


def new_alike(spark, sf_dir):
    """Suppliers of the nation of new ones whose names are alike."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("topic"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).otherwise("").alias("summary"), F.concat(F.lit("S "), F.col("s_name")).alias("full_text"))
    return retrieval.similar_new(s.filter("id % 10 = 0"), s, 0.5)


def alike_across_chats(spark, sf_dir):
    """Nations of different regions with like names, under topics with like names."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = n.select(F.col("n_nationkey").alias("id"), "n_regionkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "n_name").select((F.col("id") * 10 + F.col("k")).alias("id"), F.concat(F.lit("c"), (F.col("k") % 3).cast("string")).alias("chat"), F.concat(F.lit("topic of "), (F.col("n_regionkey") % 4).cast("string"), F.lit(" things")).alias("topic"), F.concat(F.lit("use "), F.col("n_name"), F.lit(" for "), F.col("k").cast("string")).alias("summary"))
    return retrieval.across_chats(rows, 0.8, 0.6)


QUERIES = {f.__name__: f for f in (hybrid_topk, hybrid_topk_each, retrieve, retrieve_reranked, diverse_topk, layered_topk, label_centroids, entity_paths, nearest_in_topic, new_alike, alike_across_chats)}

_VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(TEXTS))
_SIGNALS = rf"""q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM (VALUES {_VALUES}) v(query_id, query)),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t), c AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM t),
p AS (SELECT doc_id, l, term, count(*) AS tf FROM c WHERE term IN (SELECT term FROM q) GROUP BY ALL), i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, mean FROM p, st GROUP BY term, n, mean),
j AS (SELECT query_id, term, mean, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS idf FROM i JOIN q USING (term)),
wt AS (SELECT query_id AS text, doc_id AS id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM p JOIN j USING (term) WHERE query_id <> 3 GROUP BY ALL),
qs AS (SELECT vec_id AS query_id, vec_id // 50 % {len(TEXTS)} AS text FROM embeddings WHERE vec_id % 50 = 0), w AS (SELECT query_id, id, score FROM wt JOIN qs USING (text)),
pr AS (SELECT query_id, embedding AS probe FROM embeddings JOIN qs ON query_id = vec_id WHERE text <> 2),
dn AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(probe AS DOUBLE[])), 9) AS score FROM embeddings, pr),
sg AS (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY score DESC, id) AS r FROM (SELECT 'w' AS s, * FROM w WHERE score > 0 UNION ALL SELECT 'd', * FROM dn) QUALIFY r <= 30),
ns AS (SELECT query_id, count(DISTINCT s) AS k FROM sg GROUP BY query_id),
fu AS (SELECT sg.query_id, id, CASE WHEN any_value(k) > 1 THEN coalesce(max(1e0 / (60 + r)) FILTER (WHERE s = 'd'), 0e0) + coalesce(max(1e0 / (60 + r)) FILTER (WHERE s = 'w'), 0e0) ELSE max(score) END AS score FROM sg JOIN ns ON ns.query_id = sg.query_id GROUP BY sg.query_id, id),
fo AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 50)"""

_RANKED = "rk AS (SELECT query_id, id, score, lang, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM {f} JOIN documents ON doc_id = id)"

ORACLE = {
    "retrieve": f"""WITH {_SIGNALS},
sl AS (SELECT * FROM (SELECT qs.query_id, query FROM qs JOIN (VALUES {_VALUES}) v(text, query) USING (text) UNION ALL SELECT -1, 'oken =') WHERE query_id NOT IN (SELECT query_id FROM fo)),
fb AS (SELECT query_id, doc_id AS id, 0e0 AS score FROM documents, sl WHERE contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), lower(query)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY doc_id) <= 50),
al AS (SELECT * FROM fo UNION ALL SELECT * FROM fb), {_RANKED.format(f='al')},
gr AS (SELECT query_id, CASE WHEN coalesce(lang, '') = '' THEN 'general' ELSE lang END AS topic, id, score, rank FROM rk),
g2 AS (SELECT *, min(rank) OVER (PARTITION BY query_id, topic) AS f, count(*) OVER (PARTITION BY query_id, topic) AS matches, row_number() OVER (PARTITION BY query_id, topic ORDER BY rank) - 1 AS place FROM gr)
SELECT query_id, topic, dense_rank() OVER (PARTITION BY query_id ORDER BY f) - 1 AS topic_rank, place, matches, id AS doc_id, round(score, 9) AS score FROM g2 QUALIFY place < 10""",
    "retrieve_reranked": f"""WITH {_SIGNALS}, {_RANKED.format(f='fo')}, rr AS (SELECT query_id, id, rank, CASE WHEN id % 3 > 0 THEN (id * 7919 % 1009) / 1009e0 ELSE 0e0 END AS new FROM rk)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY new DESC, rank) - 1 AS rank, round(new, 9) AS score FROM rr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY new DESC, rank) <= 15""",
    "layered_topk": """WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, i, avg(v[i]) AS x FROM v, range(1, 65) t(i) GROUP BY ALL), m AS (SELECT label AS id, list(x ORDER BY i) AS v FROM u GROUP BY label),
l AS (SELECT 'topic' AS layer, CAST(id AS BIGINT) AS id, v, 5 AS k FROM m UNION ALL SELECT 'episode', id, v, 10 FROM v)
SELECT q.id AS query_id, layer, l.id, round(list_cosine_similarity(l.v, q.v), 9) AS score FROM l, (SELECT * FROM v WHERE id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.id, layer ORDER BY round(list_cosine_similarity(l.v, q.v), 9) DESC, l.id) <= k""",
    "label_centroids": """WITH u AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY ALL)
SELECT label AS cluster, max(n) AS n, round(max(x) FILTER (WHERE i = 1) / sqrt(sum(x * x)), 6) AS first, round(max(x) FILTER (WHERE i = 64) / sqrt(sum(x * x)), 6) AS last FROM u GROUP BY label""",
    "entity_paths": """WITH q AS (SELECT * FROM (VALUES (1, 7), (1, 12), (2, 100), (2, 7)) v(query_id, p)),
m AS (SELECT DISTINCT query_id, p, l_orderkey AS s FROM q JOIN lineitem ON l_partkey = p), r AS (SELECT o_orderkey AS id, unnest([o_orderkey, o_orderkey // 2]) AS s FROM orders),
f AS (SELECT query_id, id, count(DISTINCT p) AS n FROM m JOIN r ON r.s = m.s GROUP BY ALL)
SELECT query_id, id, round(1e0 / row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id), 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) <= 30""",
    "nearest_in_topic": """WITH v AS (SELECT vec_id AS id, label AS topic, CAST(embedding AS DOUBLE[]) AS v, 'text ' || (vec_id % 30) || ' of it' AS t FROM embeddings),
g AS (SELECT *, list_distinct([t[i : i + 1] FOR i IN range(1, length(t))]) AS g FROM v),
p AS (SELECT a.id, b.id AS match, round(list_cosine_similarity(a.v, b.v), 9) AS c, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS s FROM g a JOIN g b ON a.topic = b.topic AND a.id <> b.id WHERE a.id % 50 = 0),
n AS (SELECT id, match, c AS score, 'vector' AS kind FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, match) = 1 AND c > 0.25),
x AS (SELECT id, match, CAST(s AS DOUBLE) AS score, 'text' AS kind FROM p WHERE s >= 0.15 AND id NOT IN (SELECT id FROM n) QUALIFY row_number() OVER (PARTITION BY id ORDER BY match) = 1)
SELECT * FROM n UNION ALL SELECT * FROM x""",
    "new_alike": """WITH s AS (SELECT s_suppkey AS id, s_nationkey AS topic, lower(CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE 'S ' || s_name END) AS t FROM supplier),
g AS (SELECT *, list_distinct([t[i : i + 1] FOR i IN range(1, length(t))]) AS g FROM s)
SELECT a.id, b.id AS match, CAST(round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS DOUBLE) AS similarity FROM g a JOIN g b ON a.topic = b.topic AND a.id <> b.id WHERE a.id % 10 = 0 AND round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) >= 0.5""",
    "alike_across_chats": """WITH r AS (SELECT CAST(n_nationkey AS INT) * 10 + k AS id, 'c' || (k % 3) AS chat, 'topic of ' || (n_regionkey % 4) || ' things' AS topic, lower('use ' || n_name || ' for ' || k) AS t FROM nation, range(0, 4) x(k)),
g AS (SELECT *, list_distinct([t[i : i + 1] FOR i IN range(1, length(t))]) AS g, list_distinct([topic[i : i + 1] FOR i IN range(1, length(topic))]) AS h FROM r)
SELECT CAST(a.id AS INT) AS id_a, CAST(b.id AS INT) AS id_b, CAST(round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS DOUBLE) AS similarity FROM g a JOIN g b ON a.id < b.id AND a.chat <> b.chat
WHERE len(list_intersect(a.h, b.h)) >= 0.8 * len(list_distinct(list_concat(a.h, b.h))) AND len(list_intersect(a.g, b.g)) >= 0.6 * len(list_distinct(list_concat(a.g, b.g)))""",
    "hybrid_topk": """
WITH p AS (SELECT embedding AS probe, label AS probe_label FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(probe AS DOUBLE[])), 9) AS dense, -abs(label - probe_label) AS scalar FROM embeddings, p WHERE vec_id <> 0),
d AS (SELECT vec_id, row_number() OVER (ORDER BY dense DESC, vec_id) AS r FROM s QUALIFY r <= 60),
c AS (SELECT vec_id, row_number() OVER (ORDER BY scalar DESC, vec_id) AS r FROM s QUALIFY r <= 60),
f AS (SELECT coalesce(d.vec_id, c.vec_id) AS vec_id, round(coalesce(1.0 / (60 + d.r), 0.0) + coalesce(1.0 / (60 + c.r), 0.0), 9) AS score FROM d FULL JOIN c ON d.vec_id = c.vec_id)
SELECT f.vec_id, f.score, e.label FROM (SELECT * FROM f ORDER BY score DESC, vec_id LIMIT 20) f JOIN embeddings e ON e.vec_id = f.vec_id
""",
    "hybrid_topk_each": """
WITH p AS (SELECT vec_id AS query_id, embedding AS probe, label AS probe_label FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(probe AS DOUBLE[])), 9) AS dense, -abs(label - probe_label) AS scalar FROM embeddings, p WHERE vec_id <> query_id),
d AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS r FROM s WHERE dense IS NOT NULL QUALIFY r <= 60),
c AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY scalar DESC, vec_id) AS r FROM s WHERE scalar IS NOT NULL QUALIFY r <= 60),
f AS (SELECT coalesce(d.query_id, c.query_id) AS query_id, coalesce(d.vec_id, c.vec_id) AS vec_id, round(coalesce(1.0 / (60 + d.r), 0.0) + coalesce(1.0 / (60 + c.r), 0.0), 9) AS score FROM d FULL JOIN c ON d.query_id = c.query_id AND d.vec_id = c.vec_id)
SELECT query_id, vec_id, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
}
