"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chat, codes, contamination, language, mixing, near_dedup, negatives, passages, pieces, quality, secrets, sharding, toxicity
from threadloom.llm.common import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one full of control strings, read back from their windows."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_windows(conversations.unionByName(tricky)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur in earlier documents."""
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


#: Twice the default weight for domain0; German and Spanish over their natural share.
MIX_WEIGHTS = {("domain0",): 2.0, **{(d, lang): w for d in ("domain0", "domain1", "domain2", "domain3") for lang, w in (("en", 2.0), ("de", 1.0), ("fr", 1.0), ("es", 1.0))}}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that make up 60 % of all tokens at target weights, at most two epochs of each."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), share=0.6, weights=MIX_WEIGHTS, epochs=2)
    return mixed.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_copies").alias("copies"), F.col("_leaf_budget").alias("leaf_budget"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the learned decision list."""
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge_quality(docs.select("doc_id", "text"), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards cut from their Hilbert order."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score_documents(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document."""
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_languages(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model, ["doc_id"])
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document in a vocabulary of 32,000 pieces, and the text that they decode to, as digests."""
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in eight digits of 16 entries each."""
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector, where every seventh label is wrong."""
    id_ = F.col("vec_id")
    label = F.when(id_ % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), id_ % 100 == 0)


QUERIES = {"op11_sentencepiece": op11_sentencepiece, "op12_vector_codes": op12_vector_codes, "op13_hard_negatives": op13_hard_negatives, "op9_secret_scan": op9_secret_scan, "op8_toxicity": op8_toxicity, "op6_near_dedup": op6_near_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_mixing": op3_mixing, "op5_decontamination": op5_decontamination, "op1_chat_formatting": op1_chat_formatting, "op10_language_id": op10_language_id, "op4_quality_rules": op4_quality_rules, "op7_hilbert_sharding": op7_hilbert_sharding}

#: Distinct 5-word shingles of lower-cased texts; a text of fewer words is one shingle.
_SHINGLES = """
{name}_words AS (SELECT {id} AS id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM {table} WHERE text IS NOT NULL),
{name}_sets AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM {name}_words)"""

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 6) -> str:
    """The rounds of op12 one after the other."""
    assigned = """a{k} AS MATERIALIZED (SELECT vec_id, p, v, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM
(SELECT x.vec_id, x.p, x.v, c.e, list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, len(x.v) + 1)]) AS d FROM parts x JOIN c{k} c ON c.p = x.p) GROUP BY ALL)"""
    moved = """n{k} AS (SELECT p, e, count(*) AS n, list(v) AS vs FROM a{k} GROUP BY p, e),
c{next} AS MATERIALIZED (SELECT c.p, c.e, CASE WHEN n IS NULL THEN c.v ELSE [CAST(floor(list_sum(list_transform(vs, lambda v: v[i])) / n) AS BIGINT) FOR i IN range(1, len(c.v) + 1)] END AS v FROM c{k} c LEFT JOIN n{k} ON n{k}.p = c.p AND n{k}.e = c.e)"""
    steps = [assigned.format(k=k) + ", " + moved.format(k=k, next=k + 1) for k in range(rounds)]
    last = rounds
    return f"""WITH kept AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE {_WHOLE}),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM kept, range(8) AS r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16),
c0 AS (SELECT p, e, v FROM parts JOIN first USING (vec_id)),
{", ".join(steps)}, {assigned.format(k=last)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{last}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""


ORACLE: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op13_hard_negatives": f"""WITH e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT pos.a AS anchor_id, pos.b AS positive_id, CAST(row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY n.s DESC, n.b) AS INT) AS rank, n.b AS negative_id, pos.s AS positive_score, n.s AS negative_score
FROM pos JOIN s n ON n.a = pos.a AND NOT n.same AND 30 * pos.s <= 100 * n.s AND 100 * n.s <= 90 * pos.s QUALIFY rank <= 10""",
    "op5_decontamination": "WITH "
    + _SHINGLES.format(name="d", id="doc_id", table="documents")
    + ", "
    + _SHINGLES.format(name="b", id="item_id", table="benchmark")
    + """,
sizes AS (SELECT id, count(*) AS n_item FROM b_sets GROUP BY id),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d_sets d JOIN b_sets b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, CAST(n_shared AS DOUBLE) / n_item AS containment FROM shared JOIN sizes ON sizes.id = item_id WHERE n_shared >= 0.75 * n_item""",
    "op6_near_dedup": "WITH RECURSIVE "
    + _SHINGLES.format(name="d", id="doc_id", table="documents")
    + """,
sizes AS (SELECT id, count(*) AS n FROM d_sets GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM d_sets a JOIN d_sets b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least ON least.a = doc_id LEFT JOIN sizes ON sizes.id = doc_id""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
