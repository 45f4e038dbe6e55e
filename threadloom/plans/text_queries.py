"""Text and search queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import aggregates, dedup, search, windows


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noise_messages(spark, sf_dir):
    """Turns by role: all, noise, with a decision signal, bare links."""
    c = _read(spark, sf_dir, "conversations")
    n = lambda test, name: F.count_if(test).alias(name)
    text = F.coalesce("text", F.lit(""))
    return c.groupBy("role").agg(F.count("*").alias("n"), n(T.is_noise(F.col("text")), "noise"), n(T.has_decision_signal(text), "signals"), n(T.is_link_only(text), "links"))


def keyword_search(spark, sf_dir):
    """The English documents that hold a phrase, whatever the case, the longest first."""
    found = search.keyword_search(_read(spark, sf_dir, "documents"), "The", ["text", "source"], F.col("lang") == "en")
    return found.select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id")


def keyword_matches(spark, sf_dir):
    """All English documents that hold a phrase, whatever the case, in no order."""
    found = search.keyword_search(_read(spark, sf_dir, "documents"), "The", ["text", "source"], F.col("lang") == "en")
    return found.select("doc_id", "source", "n_chars")


def keyword_frequency(spark, sf_dir):
    """The commonest words of user turns."""
    return aggregates.keyword_frequency(_read(spark, sf_dir, "conversations").filter("role = 'user'"), "text", 50)


def bm25_topk(spark, sf_dir):
    """The best documents for a query by Okapi BM25."""
    query = "the secret token of data"
    scored = search.bm25(_read(spark, sf_dir, "documents"), query, "doc_id", "text")
    return search.top(scored.withColumn("score", F.round("score", 6)).filter("score > 0"), 20).select(F.col("id").alias("doc_id"), "score")


#: The queries of bm25_topk_each.
TEXTS = ("the secret token of data", "the license of this software", "better than that", "by or from a nation", "data", "License, of (this) SOFTWARE?")


def bm25_topk_each(spark, sf_dir):
    """The best documents for each of TEXTS by Okapi BM25."""
    scored = search.bm25_each(_read(spark, sf_dir, "documents"), dict(enumerate(TEXTS)), "doc_id", "text")
    return search.top_each(scored.withColumn("score", F.round("score", 6)).filter("score > 0"), 20).select("query_id", F.col("id").alias("doc_id"), "score")


def text_scalars(spark, sf_dir):
    """Scalars of every benchmark item: bigrams, hash, truncation, tokens."""
    t = F.coalesce("text", F.lit(""))
    b = _read(spark, sf_dir, "benchmark")
    return b.select(
        "item_id",
        F.size(T.bigrams(F.lower(t))).cast("long").alias("n_bigrams"),
        T.content_hash(t).alias("hash"),
        T.truncate(t, 40).alias("short"),
        F.size(T.search_tokens(t)).cast("long").alias("n_tokens"),
        F.round(T.bigram_jaccard(t, F.reverse(t)), 9).alias("mirror"),
        F.round(T.character_overlap(t, F.lit("abcdefghij")), 9).alias("overlap"),
    )


def fuzzy_benchmark_pairs(spark, sf_dir):
    """Pairs of benchmark items whose bigram sets are similar; the items are one block."""
    items = _read(spark, sf_dir, "benchmark").withColumn("topic", F.lit("all"))
    found = dedup.fuzzy_pairs(items, "item_id", "topic", "text", 0.35)
    return found.select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


def turn_segments(spark, sf_dir):
    """Runs of turns by one role in each conversation."""
    c = windows.segments(_read(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"], "role")
    return c.groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.min("role").alias("role"))


def turns_within_budget(spark, sf_dir):
    """Turns while those before them have under 400 characters."""
    c = _read(spark, sf_dir, "conversations").filter("turn IS NOT NULL").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("cost"))
    c = c.groupBy("conv_id", "turn").agg(F.sum("cost").alias("cost"))
    return windows.within_budget(c, "conv_id", ["turn"], "cost", 400).select("conv_id", "turn", "cost", "spent")


def longest_per_source(spark, sf_dir):
    """The longest document of each source and language, the smallest id among equals."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return aggregates.best_by(d, ["source", "lang"], F.col("n_chars"), F.col("doc_id"))


def majority_language(spark, sf_dir):
    """The language that over half of a source's documents have."""
    return aggregates.majority(_read(spark, sf_dir, "documents").filter("source IS NOT NULL"), ["source"], "lang").filter("winner IS NOT NULL")


def label_scores(spark, sf_dir):
    """Precision, recall and F1 by language of 'short documents are of low quality'."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id")
    judged = d.filter("quality IS NOT NULL AND n_chars IS NOT NULL").select("lang", (F.col("quality") == 0).alias("expected"), (F.col("n_chars") < 600).alias("found"))
    scores = aggregates.group_scores(judged, ["lang"])
    return scores.select("lang", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def label_confusion(spark, sf_dir):
    """Quality by toxicity."""
    return aggregates.confusion(_read(spark, sf_dir, "labels").filter("quality IS NOT NULL AND toxic IS NOT NULL"), "quality", "toxic", [0, 1])


def top_per_topic(spark, sf_dir):
    """The three longest documents of each source."""
    d = _read(spark, sf_dir, "documents").filter("source IS NOT NULL")
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return d.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("source", "place", "doc_id", "n_chars")


QUERIES = {f.__name__: f for f in (noise_messages, keyword_search, keyword_matches, keyword_frequency, bm25_topk, bm25_topk_each, text_scalars, fuzzy_benchmark_pairs, turn_segments, turns_within_budget, longest_per_source, majority_language, label_scores, label_confusion, top_per_topic)}

_SIGNAL = "|".join(T.DECISION_SIGNALS)
_EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{FE00}-\x{FE0F}\x{200D}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}"
_BIGRAMS = "list_distinct(CASE WHEN length({t}) >= 2 THEN [{t}[i : i + 1] FOR i IN range(1, length({t}))] ELSE [] END)"
_CLEAR = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"

ORACLE = {
    "noise_messages": f"""
WITH c AS (SELECT role, coalesce(text, '') AS t, {_CLEAR} AS x FROM conversations),
s AS (SELECT *, regexp_matches(lower(x), '{_SIGNAL}') AS sig, regexp_matches(x, '(?s)^https?://\\S*(\\s+.{{0,2}})?$') AS link,
regexp_replace(x, '[\\s.,!?，。！？、]', '', 'g') AS bare, regexp_replace(x, '[^{_EMOJI}]', '', 'g') AS emoji FROM c)
SELECT role, count(*) AS n, count(*) FILTER (WHERE x = '' OR (bare <> '' AND length(emoji) > 0.8 * length(bare)) OR lower(x) IN ({", ".join(f"'{w}'" for w in T.NOISE_WORDS)}) OR (length(x) < 5 AND NOT sig) OR (regexp_matches(lower(x), '{"|".join(T.NOISE_TOPICS)}') AND NOT sig) OR link) AS noise,
count(*) FILTER (WHERE regexp_matches(lower(t), '{_SIGNAL}')) AS signals, count(*) FILTER (WHERE link) AS links FROM s GROUP BY role""",
    "keyword_search": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND (contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(source, '')), 'the')) ORDER BY n_chars DESC, doc_id",
    "keyword_matches": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND (contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(source, '')), 'the'))",
    "keyword_frequency": r"""
WITH w AS (SELECT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+')) AS word FROM conversations WHERE role = 'user')
SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 GROUP BY word ORDER BY n DESC, word LIMIT 50""",
    "bm25_topk": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, unnest(list_filter(t, lambda x: x IN ('the', 'secret', 'token', 'of', 'data'))) AS term FROM t),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
p AS (SELECT doc_id, l, term, count(*) AS tf FROM c GROUP BY ALL),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, mean FROM p, st GROUP BY term, n, mean),
j AS (SELECT term, mean, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i)
SELECT * FROM (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM p JOIN j USING (term) GROUP BY doc_id) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "bm25_topk_each": r"""
WITH q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]{2,}')) AS term FROM (VALUES (0, 'the secret token of data'), (1, 'the license of this software'), (2, 'better than that'), (3, 'by or from a nation'), (4, 'data'), (5, 'License, of (this) SOFTWARE?')) v(query_id, query)),
t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
c AS (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM t),
p AS (SELECT doc_id, l, term, count(*) AS tf FROM c WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf, mean FROM p, st GROUP BY term, n, mean),
j AS (SELECT query_id, term, mean, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS idf FROM i JOIN q USING (term)),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM p JOIN j USING (term) GROUP BY ALL)
SELECT query_id, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20""",
    "text_scalars": rf"""
WITH b AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark),
g AS (SELECT *, lower(t) AS w, lower(trim(t)) AS x, lower(trim(reverse(t))) AS y FROM b),
h AS (SELECT *, {_BIGRAMS.format(t="w")} AS gw, {_BIGRAMS.format(t="x")} AS gx, {_BIGRAMS.format(t="y")} AS gy, list_distinct(string_split(w, '')) AS ct FROM g)
SELECT item_id, CAST(len(gw) AS BIGINT) AS n_bigrams, left(sha256(t), 16) AS hash, CASE WHEN length(t) <= 40 THEN t ELSE left(t, 37) || '...' END AS short,
CAST(len(regexp_extract_all(w, '[\p{{L}}\p{{N}}_]{{2,}}')) AS BIGINT) AS n_tokens,
round(len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy))), 9) AS mirror,
round(len(list_intersect(ct, string_split('abcdefghij', ''))) / greatest(len(ct), 10), 9) AS overlap FROM h""",
    "fuzzy_benchmark_pairs": f"""
WITH g AS (SELECT item_id, lower(trim(text)) AS t FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, {_BIGRAMS.format(t="t")} AS g FROM g),
p AS (SELECT a.item_id AS id_a, b.item_id AS id_b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS total FROM s a JOIN s b ON a.item_id < b.item_id)
SELECT id_a, id_b, round(n / (total - n), 9) AS similarity FROM p WHERE n >= 0.35 * (total - n) AND total > n""",
    "turn_segments": """
WITH l AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS BIGINT) AS segment FROM l)
SELECT conv_id, segment, count(*) AS n, min(turn) AS first_turn, min(role) AS role FROM s GROUP BY ALL""",
    "turns_within_budget": """
WITH c AS (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS cost FROM conversations WHERE turn IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM c)
SELECT conv_id, turn, cost, spent FROM s WHERE spent < 400""",
    "longest_per_source": "SELECT doc_id, source, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC NULLS LAST, doc_id) = 1",
    "majority_language": """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS votes FROM c)
SELECT source, votes, lang AS winner FROM s WHERE 2 * n > votes AND lang IS NOT NULL""",
    "label_scores": """
WITH j AS (SELECT lang, quality = 0 AS e, n_chars < 600 AS f FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
c AS (SELECT lang, count(*) FILTER (WHERE e AND f) AS tp, count(*) FILTER (WHERE NOT e AND f) AS fp, count(*) FILTER (WHERE e AND NOT f) AS fn FROM j GROUP BY lang)
SELECT lang, tp, fp, fn, CAST(round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS DOUBLE) AS precision, CAST(round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS DOUBLE) AS recall, CAST(round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS DOUBLE) AS f1 FROM c""",
    "label_confusion": "SELECT quality AS expected, count(*) FILTER (WHERE toxic = 0) AS found_0, count(*) FILTER (WHERE toxic = 1) AS found_1 FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality",
    "top_per_topic": "SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS place, doc_id, n_chars FROM documents WHERE source IS NOT NULL QUALIFY place <= 3",
}
