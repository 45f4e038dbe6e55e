"""Queries of rollups: events as messages and as stored results, conversations as messages with references."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import rollups as R
from threadloom.plans.base import read


def chat_rollup(spark, sf_dir):
    """Size, expected decisions, participants and topic of each chat."""
    k = F.col("l_linenumber")
    m = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chat"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"),
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("l_suppkey") % 4).cast("string"))).alias("speaker"),
        F.when(k % 3 > 0, F.col("l_returnflag")).alias("topic"),
        F.when(k % 4 > 0, F.col("l_shipdate")).alias("at"),
        F.when(k % 2 == 0, F.element_at(F.array(F.lit("True"), F.lit("no")), (F.col("l_partkey") % 2 + 1).cast("int"))).alias("expected"),
    )
    return R.chat_rollup(m).withColumn("participants", F.array_join("participants", ","))


def memo_stats(spark, sf_dir):
    """Stored results by kind."""
    return R.memo_stats(read(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("event_id") % 7).alias("hits"), F.col("event_id").alias("created_at")))


def participant_ids(spark, sf_dir):
    """Whom each message is from and refers to."""
    t = F.coalesce(F.col("turn"), F.lit(0)).cast("string")
    refs = F.array(F.concat(F.lit('{"_id": "a'), t, F.lit('", "id": "x"}')), F.lit('{"id": "b"}'), F.lit('{"name": "c"}'), F.concat(F.lit("d"), t), F.col("role"))
    ids = R.participant_ids(F.col("role"), F.when(F.col("conv_id") % 4 > 0, refs))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(ids, ",").alias("ids"))


def dimension_accuracy(spark, sf_dir):
    """Share of right answers by dimension."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("dimension"), (F.col("o_orderkey") % 3 == 0).alias("correct"))
    return R.dimension_accuracy(rows, ["F", "O", "P", "none"])


def scenario_counts(spark, sf_dir):
    """Expected lines by scenario."""
    return R.scenario_counts(read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("scenario")))


QUERIES = {f.__name__: f for f in (chat_rollup, memo_stats, participant_ids, dimension_accuracy, scenario_counts)}

ORACLE = {
    "chat_rollup": """WITH m AS (SELECT l_orderkey AS chat, l_linenumber * 1000000 + l_partkey AS id, CASE WHEN l_suppkey % 5 <> 0 THEN 'u' || (l_suppkey % 4) END AS speaker, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END AS topic,
CASE WHEN l_linenumber % 4 > 0 THEN l_shipdate END AS d, l_linenumber % 2 = 0 AND l_partkey % 2 = 0 AS expected FROM lineitem),
p AS (SELECT chat, string_agg(speaker, ',' ORDER BY first, speaker) AS participants FROM (SELECT chat, speaker, min(id) AS first FROM m WHERE speaker IS NOT NULL GROUP BY ALL) GROUP BY chat),
t AS (SELECT chat, topic FROM (SELECT chat, topic, count(*) AS k FROM m WHERE topic IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chat ORDER BY k DESC, topic) = 1),
c AS (SELECT chat, count(*) AS n, count(*) FILTER (WHERE expected) AS n_expected, arg_min(d, (id, d)) FILTER (WHERE d IS NOT NULL) AS first_at FROM m GROUP BY chat)
SELECT c.chat, n, n_expected, coalesce(participants, '') AS participants, coalesce(topic, 'general') AS topic, first_at FROM c LEFT JOIN p ON p.chat = c.chat LEFT JOIN t ON t.chat = c.chat""",
    "memo_stats": "SELECT coalesce(event_type, 'all') AS type, count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS hits, min(event_id) AS oldest, max(event_id) AS newest FROM events GROUP BY ROLLUP (event_type)",
    "participant_ids": """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN conv_id % 4 > 0 THEN [nullif(role, ''), 'a' || coalesce(turn, 0), 'b', 'd' || coalesce(turn, 0), role] ELSE [nullif(role, '')] END, lambda x: x IS NOT NULL))), ',') AS ids FROM conversations""",
    "dimension_accuracy": """WITH x AS (SELECT d AS dimension, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS correct FROM unnest(['F', 'O', 'P', 'none']) t(d) LEFT JOIN orders ON o_orderstatus = d GROUP BY d),
y AS (SELECT * FROM x UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), CAST(sum(correct) AS BIGINT) FROM x)
SELECT dimension, n, correct, CASE WHEN n > 0 THEN round(CAST(correct AS DOUBLE) / n, 4) ELSE 0e0 END AS accuracy FROM y""",
    "scenario_counts": "SELECT CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'unknown' ELSE o_orderpriority END AS scenario, count(*) AS n FROM orders GROUP BY 1",
}
