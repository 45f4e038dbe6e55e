"""Queries of evaluations: orders of one kind as expected decisions, of another as found ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import evaluation as E
from threadloom.plans.base import read


def _rows(spark, sf_dir, rest, key):
    k = F.col("o_orderkey")
    topic = F.when(k % 11 == 0, "general").when(k % 13 == 0, "extra").otherwise(F.col("o_orderpriority")) if key == "a" else F.col("o_orderpriority")
    summary = F.concat(F.lit("keep "), F.col("o_orderstatus"), F.lit(" for "), F.col("o_orderpriority"), F.lit(" "), (k % 97).cast("string"))
    return read(spark, sf_dir, "orders").filter(k % 3 == rest).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("chat"), k.alias(key), topic.alias("topic"), summary.alias("summary"), (k % 5 == 0).alias("suggestion"), F.col("o_orderstatus").alias("status"), (k % 4).cast("int").alias("session"), ((k % 3) / 10.0).alias("noise_ratio"))


def _both(spark, sf_dir):
    return _rows(spark, sf_dir, 0, "e"), _rows(spark, sf_dir, 1, "a")


def _judged(spark, sf_dir):
    e, a = _both(spark, sf_dir)
    return E.judged(e, a, E.matched(e, a))


def match_decisions(spark, sf_dir):
    """Which found decision every expected one gets, one to one, in order."""
    e, a = _both(spark, sf_dir)
    return E.matched(e, a).select("chat", F.col("l").alias("e"), F.col("r").alias("a"), "score")


def match_metrics(spark, sf_dir):
    """All measures in one row."""
    return E.metrics(_judged(spark, sf_dir))


def match_by_topic(spark, sf_dir):
    """Measures by topic."""
    return E.metrics_by(_judged(spark, sf_dir), "topic")


def match_by_chat(spark, sf_dir):
    """Measures by chat."""
    return E.metrics_by(_judged(spark, sf_dir), "chat")


def match_misses(spark, sf_dir):
    """Topics with the most misses."""
    return E.misses_by_topic(_judged(spark, sf_dir))


def chat_isolation(spark, sf_dir):
    """How often a topic is found in another chat than it is expected in."""
    return E.isolation(*_both(spark, sf_dir))


def recall_decay(spark, sf_dir):
    """Recall by days between sessions."""
    e, a = _both(spark, sf_dir)
    days = F.element_at(F.array(*[F.lit(d) for d in (0, 2, 5, 20)]), F.col("session") + 1)
    sessions = e.select("chat", "session").distinct().withColumn("day_gap", days)
    return E.recall_by_gap(e, a, sessions)


def recall_half_life(spark, sf_dir):
    """Consistency over sessions, decay and half-life in one row."""
    return E.decay(recall_decay(spark, sf_dir))


def noise_robustness(spark, sf_dir):
    """False positives by share of noise."""
    a = read(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 4) / 10.0).alias("noise_ratio"), (F.col("o_orderkey") % 7 == 0).alias("fp"))
    return E.noise_robustness(a.withColumn("noise_ratio", F.when(F.col("noise_ratio") > 0, F.col("noise_ratio"))))


def _strict(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    chat = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"))
    messages = l.select(chat.alias("chat"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("msg_id"), F.concat(F.lit("ship part "), F.col("l_partkey").cast("string"), F.lit(" by "), F.col("l_linestatus")).alias("msg")).dropDuplicates(["chat", "msg_id"])
    o = read(spark, sf_dir, "orders")
    own = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    expected = o.filter("o_orderkey % 2 = 0").select(own.alias("chat"), F.lit(1).alias("e"), F.lit("m1").alias("msg_id")).unionByName(o.filter("o_orderkey % 6 = 0").select(own.alias("chat"), F.lit(2).alias("e"), F.lit("m2").alias("msg_id")))
    out = o.select(own.alias("chat"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("a"), F.col("o_orderkey").alias("k"))
    cited = F.when(F.col("a") == 1, F.array(F.lit("m1"))).when(F.col("a") == 2, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array(F.concat(F.lit("m"), (F.col("k") % 9).cast("string"))))
    outputs = out.select("chat", "a", cited.alias("cited"), F.when(F.col("k") % 10 == 0, "no such words").otherwise("ship part").alias("quote"), F.when(F.col("k") % 8 == 0, "discussion").otherwise("choice").alias("kind"), (F.col("k") % 9 == 0).alias("suggestion"), F.lit("decided").alias("status"))
    verdicts = out.filter("a = 3").select("chat", "a", F.when(F.col("k") % 3 == 0, "match_gt").when(F.col("k") % 3 == 1, "valid_extra").otherwise("invalid").alias("verdict"), F.when(F.col("k") % 3 == 0, "m2").alias("matched"))
    return outputs, expected, messages, verdicts


def strict_outcomes(spark, sf_dir):
    """What every confirmed output counts as."""
    return E.strict_outcomes(*_strict(spark, sf_dir))


def strict_metrics(spark, sf_dir):
    """Strict measures in one row."""
    outputs, expected, messages, verdicts = _strict(spark, sf_dir)
    return E.strict_metrics(E.strict_outcomes(outputs, expected, messages, verdicts), expected)


def strict_unmatched(spark, sf_dir):
    """Expected rows that nothing matches."""
    outputs, expected, messages, verdicts = _strict(spark, sf_dir)
    return E.unmatched(E.strict_outcomes(outputs, expected, messages, verdicts), expected)


def assignment_errors(spark, sf_dir):
    """What is wrong with a judge's rows."""
    outputs, expected, _, verdicts = _strict(spark, sf_dir)
    return E.assignment_errors(verdicts, outputs.filter("a = 3 AND NOT suggestion"), expected).groupBy("error").agg(F.count("*").alias("n"))


def best_matches(spark, sf_dir):
    """The expected decision of its chat that each found one, with its body, is most like."""
    e, a = _both(spark, sf_dir)
    return E.best_matches(e, a.withColumn("body", F.concat(F.lit("We "), "summary", F.lit(", "), "topic")), "chat")


def scenario_matches(spark, sf_dir):
    """Which found decision meets each expected one of a web scenario."""
    return E.scenario_matches(_scenarios(spark, sf_dir), _rows(spark, sf_dir, 1, "a")).select("e", "scenario", "a", "effect_met")


def scenario_measures(spark, sf_dir):
    """The measures of all web scenarios in one row."""
    row = E.scenario_measures(E.scenario_matches(_scenarios(spark, sf_dir), _rows(spark, sf_dir, 1, "a")))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def _scenarios(spark, sf_dir):
    """An expected row of a scenario for each third order; effects of every fourth, conflicts of every fifth."""
    k = F.col("e")
    scenario = F.element_at(F.array(*[F.lit(x) for x in [*E.SCENARIOS, "unknown", ""]]), (k % 8 + 1).cast("int"))
    effect = F.when(k % 4 == 0, F.concat(F.lit("drop "), F.col("topic"))).otherwise("")
    return _rows(spark, sf_dir, 0, "e").select("e", scenario.alias("scenario"), "chat", "topic", "summary", effect.alias("effect_summary"), F.when(k % 7 < 3, "new_decision").when(k % 7 < 6, "no_change").otherwise("").alias("effect"), (k % 5 == 0).alias("conflict"))


def timings(spark, sf_dir):
    """Times of events by their kind."""
    return E.timings(read(spark, sf_dir, "events"), "event_type", "value")


def memory_use(spark, sf_dir):
    """Prices of orders as memory, by state, in the order of their dates."""
    return E.memory_use(read(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderdate", "o_orderkey"], "o_totalprice")


def _levels(spark, sf_dir):
    """Vectors in clusters of three levels: all, labels, and thirds of labels."""
    v = read(spark, sf_dir, "embeddings").filter("label IS NOT NULL")
    cluster = F.array(F.lit(0).cast("long"), F.col("label").cast("long"), (F.col("label") * 3 + F.col("vec_id") % 3).cast("long"))
    return v.select(F.col("vec_id").alias("id"), F.posexplode(cluster).alias("level", "cluster"))


def cluster_separation(spark, sf_dir):
    """Distances within and between clusters on three levels."""
    return E.separation(_levels(spark, sf_dir), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 64)


def cluster_granularity(spark, sf_dir):
    """How deep vectors of few and of many messages go."""
    members = _levels(spark, sf_dir).filter("level < 2 OR id % 4 > 0")
    return E.granularity(members, read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("length")))


def token_matches(spark, sf_dir):
    """Expected decisions that share tokens with a found one of their chat."""
    e, a = _both(spark, sf_dir)
    return E.token_matched(e, a, "chat", 0.8)


def _reports(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("tp"), (F.col("c_custkey") % 5).alias("fp"), (F.col("c_custkey") % 3).alias("fn"))


def merged_reports(spark, sf_dir):
    """Reports of chunks, put together."""
    return E.merged_reports(_reports(spark, sf_dir))


def repeated_runs(spark, sf_dir):
    """A measure over repeated runs."""
    return E.repeated_runs(read(spark, sf_dir, "supplier").withColumn("f1", (F.col("s_suppkey") * 37 % 101) / 100.0), "f1", 0.5)


def class_scores(spark, sf_dir):
    """Measures of each class of events against a rule, and their mean."""
    kinds = ["click", "view", "purchase"]
    e = read(spark, sf_dir, "events").filter(F.col("event_type").isin(kinds))
    found = F.when(F.col("event_id") % 10 < 6, F.col("event_type")).when(F.col("event_id") % 10 < 9, F.lit("view"))
    return E.class_scores(e.withColumn("found", found), "event_type", "found", kinds)


def run_agreement(spark, sf_dir):
    """How often three runs agree."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run"))
    return E.agreement(o.withColumn("v", F.when((F.col("o_orderkey") % 5 == 0) & (F.col("run") == 2), "b").otherwise("a")), ["o_orderkey"], "v")


def query_report(spark, sf_dir):
    """Match rate, mean and percentiles over all queries and by difficulty."""
    o = read(spark, sf_dir, "orders").withColumn("v", F.col("o_orderkey") * 7919 % 10007 / 10.0).withColumn("ok", F.col("o_orderkey") % 3 > 0)
    return E.query_report(o, "o_orderpriority", "v", "ok").withColumn("mean", F.round("mean", 4))  # at six places a mean may lie half way, where the order of a sum decides


def cluster_purity(spark, sf_dir):
    """How pure labels of vectors are by id."""
    return E.purity(read(spark, sf_dir, "embeddings").withColumn("c", F.col("vec_id") % 9), "c", "label")


def stratified_split(spark, sf_dir):
    """Customers as chats, split by segment."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") * 31 % 97 / 97.0).alias("f1"), (F.col("c_custkey") % 13).alias("tags"))
    return E.stratified_split(c, "c_mktsegment", "c_custkey", "f1", "tags")


def evaluation_gates(spark, sf_dir):
    """Whether the measures pass, and which don't."""
    return E.gates(match_metrics(spark, sf_dir), {"precision": 0.2, "recall": 0.99, "f1": 0.99})


def label_coverage(spark, sf_dir):
    """Whether labels cover all classes and no document twice."""
    return E.coverage(read(spark, sf_dir, "labels"), ["doc_id"], {"quality": [0, 1], "toxic": [0, 1, 2]})


def manifest_overlap(spark, sf_dir):
    """Nations that manifests of customers and suppliers share."""
    m = read(spark, sf_dir, "customer").select(F.lit("c").alias("manifest"), F.col("c_nationkey").alias("key")).union(read(spark, sf_dir, "supplier").filter("s_nationkey < 7").select(F.lit("s"), "s_nationkey"))
    return E.overlapping(m)


QUERIES = {
    f.__name__: f
    for f in (
        match_decisions, match_metrics, match_by_topic, match_by_chat, match_misses, chat_isolation, recall_decay, recall_half_life, noise_robustness, strict_outcomes, strict_metrics,
        strict_unmatched, assignment_errors, best_matches, token_matches, merged_reports, repeated_runs, class_scores, run_agreement, query_report, cluster_purity, stratified_split,
        evaluation_gates, label_coverage, manifest_overlap, scenario_matches, scenario_measures, timings, memory_use, cluster_separation, cluster_granularity,
    )
}

_ROWS = """b AS (SELECT 'c' || o_custkey AS chat, o_orderkey AS k, o_orderpriority AS topic, 'keep ' || o_orderstatus || ' for ' || o_orderpriority || ' ' || (o_orderkey % 97) AS summary, o_orderkey % 5 = 0 AS suggestion, o_orderstatus AS status, CAST(o_orderkey % 4 AS INT) AS session FROM orders),
e AS (SELECT * EXCLUDE k, k AS e FROM b WHERE k % 3 = 0),
a AS (SELECT chat, k AS a, CASE WHEN k % 11 = 0 THEN 'general' WHEN k % 13 = 0 THEN 'extra' ELSE topic END AS topic, summary, suggestion, status FROM b WHERE k % 3 = 1)"""
_SIM = "CAST(round(len(list_intersect({x}, {y})) / greatest(len({x}), len({y})), 9) AS DOUBLE)"
_CHARS = "list_distinct(string_split(lower({s}), ''))"
_GRAMS = "list_distinct([lower({s})[i : i + 1] FOR i IN range(1, length({s}))])"
_GREEDY = f"""WITH RECURSIVE {_ROWS},
p AS (SELECT e.chat, e.e, a.a, {_SIM.format(x=_CHARS.format(s='e.summary'), y=_CHARS.format(s='a.summary'))} AS score, e.suggestion = a.suggestion AS same FROM e JOIN a ON a.chat = e.chat AND (a.topic = 'general' OR a.topic = e.topic)),
q AS (SELECT * FROM p WHERE score >= CASE WHEN same THEN 0.3 ELSE 0.45 END),
n AS (SELECT chat, e, row_number() OVER (PARTITION BY chat ORDER BY e) AS k FROM e),
g AS (SELECT chat, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS e, CAST(NULL AS BIGINT) AS a, CAST(NULL AS DOUBLE) AS score, CAST([] AS BIGINT[]) AS used FROM n WHERE k = 1
UNION ALL SELECT g.chat, g.k + 1, any_value(n.e), arg_max(q.a, (q.score, -q.a)), max(q.score), CASE WHEN max(q.score) IS NULL THEN g.used ELSE list_append(g.used, arg_max(q.a, (q.score, -q.a))) END
FROM g JOIN n ON n.chat = g.chat AND n.k = g.k + 1 LEFT JOIN q ON q.chat = n.chat AND q.e = n.e AND NOT list_contains(g.used, q.a) GROUP BY g.chat, g.k, g.used),
m AS (SELECT chat, e, a, score FROM g WHERE a IS NOT NULL)"""
_JUDGED = _GREEDY + """,
j AS (SELECT e.chat, e.topic, e.suggestion, CASE WHEN m.a IS NULL THEN 'fn' ELSE 'tp' END AS outcome, coalesce(e.topic = a.topic, false) AS topic_right, coalesce(e.status = a.status, false) AS status_right
FROM e LEFT JOIN m ON m.chat = e.chat AND m.e = e.e LEFT JOIN a ON a.chat = m.chat AND a.a = m.a
UNION ALL SELECT chat, topic, false, 'fp', false, false FROM a WHERE NOT suggestion AND topic NOT IN ('', 'general', 'unknown') AND topic NOT IN (SELECT topic FROM e) AND NOT EXISTS (SELECT 1 FROM m WHERE m.chat = a.chat AND m.a = a.a))"""
_C = "count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn"
_R = "CAST(round(coalesce({p} / nullif({q}, 0), 0), {k}) AS DOUBLE)"


def _prf(k=4):
    return f"{_R.format(p='tp', q='tp + fp', k=k)} AS precision, {_R.format(p='tp', q='tp + fn', k=k)} AS recall, {_R.format(p='2 * tp', q='2 * tp + fp + fn', k=k)} AS f1"


_DECAY = f"""WITH {_ROWS},
h AS (SELECT DISTINCT e.chat, e.e FROM e JOIN a ON a.chat = e.chat AND a.topic = e.topic WHERE {_SIM.format(x=_CHARS.format(s='e.summary'), y=_CHARS.format(s='a.summary'))} >= 0.3),
s AS (SELECT DISTINCT chat, session, [0, 2, 5, 20][session + 1] AS gap FROM e),
x AS (SELECT CASE s.gap WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 3 ELSE 14 END AS gap, h.e IS NOT NULL AS hit FROM e JOIN s ON s.chat = e.chat AND s.session > e.session LEFT JOIN h ON h.chat = e.chat AND h.e = e.e),
y AS (SELECT CAST(g AS INT) AS gap, count(x.gap) AS total, count(*) FILTER (WHERE hit) AS correct FROM unnest([0, 1, 3, 7, 14]) t(g) LEFT JOIN x ON x.gap = g GROUP BY g),
z AS (SELECT *, {_R.format(p='correct', q='total', k=4)} AS recall FROM y)"""
_STRICT = """WITH RECURSIVE msg AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem),
o AS (SELECT o_orderkey AS k, unnest([1, 2, 3]) AS a FROM orders),
c AS (SELECT k, a, CASE a WHEN 1 THEN [1] WHEN 2 THEN [1, 2] ELSE [k % 9] END AS cited FROM o WHERE k % 8 <> 0 AND k % 9 <> 0),
v AS (SELECT c.*, k % 10 <> 0 AND len(cited) = (SELECT count(*) FROM msg WHERE msg.k = c.k AND list_contains(cited, msg.i)) AS ok FROM c),
x AS (SELECT k, 1 AS e FROM orders, LATERAL (SELECT o_orderkey AS k) WHERE k % 2 = 0 UNION ALL SELECT k, 2 FROM orders, LATERAL (SELECT o_orderkey AS k) WHERE k % 6 = 0),
p AS (SELECT v.k, v.a, x.e FROM v JOIN x ON x.k = v.k AND list_contains(v.cited, x.e) WHERE ok),
g AS (SELECT k, 0 AS a, CAST(NULL AS INT) AS e, CAST([] AS INT[]) AS used FROM (SELECT DISTINCT k FROM o)
UNION ALL SELECT g.k, g.a + 1, min(p.e), CASE WHEN min(p.e) IS NULL THEN g.used ELSE list_append(g.used, min(p.e)) END FROM g LEFT JOIN p ON p.k = g.k AND p.a = g.a + 1 AND NOT list_contains(g.used, p.e) WHERE g.a < 3 GROUP BY g.k, g.a, g.used),
u AS (SELECT k, max(CASE WHEN e = 2 THEN 1 ELSE 0 END) AS two FROM g GROUP BY k),
r AS (SELECT 'c' || v.k AS chat, v.a, CASE WHEN NOT ok THEN 'invalid' WHEN g.e IS NOT NULL THEN 'match_gt' WHEN v.a < 3 THEN 'invalid' WHEN v.k % 3 = 0 AND v.k % 6 = 0 AND u.two = 0 THEN 'match_gt' WHEN v.k % 3 = 1 THEN 'valid_extra' ELSE 'invalid' END AS outcome,
CASE WHEN NOT ok THEN '' WHEN g.e IS NOT NULL THEN 'm' || g.e WHEN v.a = 3 AND v.k % 6 = 0 AND u.two = 0 THEN 'm2' ELSE '' END AS matched,
CASE WHEN NOT ok THEN 'missing_or_invalid_evidence' WHEN g.e IS NOT NULL THEN 'exact_source_match' WHEN v.a < 3 THEN 'invalid' WHEN v.k % 3 = 0 AND NOT (v.k % 6 = 0 AND u.two = 0) THEN 'duplicate_or_unknown_match' WHEN v.k % 3 = 0 THEN 'match_gt' WHEN v.k % 3 = 1 THEN 'valid_extra' ELSE 'invalid' END AS reason
FROM v JOIN g ON g.k = v.k AND g.a = v.a JOIN u ON u.k = v.k)"""

_SCENES = f"""WITH {_ROWS}, x AS (SELECT e, ['web_simple_extract', 'web_fact_update', 'web_stale_rejection', 'web_cross_session', 'web_multi_source_merge', 'web_distractor_tolerance', 'unknown', ''][e % 8 + 1] AS scenario, chat, topic, summary,
CASE WHEN e % 4 = 0 THEN 'drop ' || topic ELSE '' END AS effect_summary, CASE WHEN e % 7 < 3 THEN 'new_decision' WHEN e % 7 < 6 THEN 'no_change' ELSE '' END AS effect, e % 5 = 0 AS conflict FROM e),
w AS (SELECT *, CASE WHEN effect_summary <> '' THEN effect_summary ELSE summary END AS wanted FROM x WHERE scenario NOT IN ('', 'unknown')),
h AS (SELECT w.e, min(a.a) AS a FROM w JOIN a ON a.chat = w.chat AND a.topic = w.topic WHERE {_SIM.format(x=_CHARS.format(s="w.wanted"), y=_CHARS.format(s="a.summary"))} >= 0.3 GROUP BY w.e),
m AS (SELECT w.*, a.a, coalesce(w.effect_summary <> '' AND {_SIM.format(x=_CHARS.format(s="w.effect_summary"), y=_CHARS.format(s="a.summary"))} >= 0.3, false) AS effect_met FROM w LEFT JOIN h ON h.e = w.e LEFT JOIN a ON a.a = h.a)"""

ORACLE = {
    "match_decisions": _GREEDY + " SELECT chat, e, a, score FROM m",
    "match_metrics": _JUDGED
    + f""", t AS (SELECT {_C}, count(*) FILTER (WHERE outcome = 'tp' AND NOT suggestion) AS dt, count(*) FILTER (WHERE outcome = 'fn' AND NOT suggestion) AS df, count(*) FILTER (WHERE outcome = 'tp' AND suggestion) AS st, count(*) FILTER (WHERE outcome = 'fn' AND suggestion) AS sf,
count(*) FILTER (WHERE outcome = 'tp' AND topic_right) AS tr, count(*) FILTER (WHERE outcome = 'tp' AND status_right) AS sr FROM j)
SELECT tp, fp, fn, {_prf()}, {_R.format(p='dt', q='tp + fp', k=4)} AS decision_precision, {_R.format(p='dt', q='dt + df', k=4)} AS decision_recall, {_R.format(p='st', q='st + sf', k=4)} AS suggestion_recall, {_R.format(p='tr', q='tp', k=4)} AS topic_accuracy, {_R.format(p='sr', q='tp', k=4)} AS status_accuracy FROM t""",
    "match_by_topic": _JUDGED + f" SELECT topic, tp, fp, fn, {_prf()} FROM (SELECT topic, {_C} FROM j GROUP BY topic)",
    "match_by_chat": _JUDGED + f" SELECT chat, tp, fp, fn, {_prf()} FROM (SELECT chat, {_C} FROM j GROUP BY chat)",
    "match_misses": _JUDGED + " SELECT topic, count(*) AS n FROM j WHERE outcome = 'fn' GROUP BY topic ORDER BY n DESC, topic LIMIT 20",
    "chat_isolation": f"""WITH {_ROWS}, x AS (SELECT topic, chat, count(*) AS n FROM e GROUP BY ALL), y AS (SELECT topic, chat, count(*) AS n FROM a GROUP BY ALL),
v AS (SELECT CAST(coalesce(sum(x.n * y.n), 0) AS BIGINT) AS v FROM x JOIN y ON x.topic = y.topic AND x.chat <> y.chat) SELECT v AS violations, CAST(round(1 - v / (SELECT count(*) FROM e), 4) AS DOUBLE) AS score FROM v""",
    "recall_decay": _DECAY + " SELECT gap, total, correct, recall FROM z",
    "recall_half_life": _DECAY
    + f""", w AS (SELECT max(recall) FILTER (WHERE gap = 0) AS r0, max(recall) FILTER (WHERE gap = 14) AS r14, sum(correct) AS c, sum(total) AS t FROM z)
SELECT {_R.format(p='c', q='t', k=4)} AS consistency, CASE WHEN r0 > 0 THEN round((r0 - r14) / 14, 4) END AS decay_rate, CASE WHEN r0 > 0 AND r0 > r14 THEN round(0.5 / ((r0 - r14) / 14), 1) END AS half_life FROM w""",
    "noise_robustness": """WITH r AS (SELECT o_orderkey % 4 AS nr, round(avg(CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE 0e0 END), 4) AS rate FROM orders GROUP BY 1)
SELECT (SELECT round(avg(CASE WHEN o_orderkey % 7 = 0 THEN 1e0 ELSE 0e0 END), 4) FROM orders) AS overall, round(var_pop(rate), 4) AS variance, round(greatest(0, 1 - avg(rate)), 4) AS score FROM r""",
    "strict_outcomes": _STRICT + " SELECT * FROM r",
    "strict_metrics": _STRICT
    + f""", t AS (SELECT count(*) FILTER (WHERE outcome = 'match_gt') AS tp, count(*) FILTER (WHERE outcome = 'invalid') AS fp, count(*) FILTER (WHERE outcome = 'valid_extra') AS valid_extra, count(*) FILTER (WHERE reason = 'missing_or_invalid_evidence') AS evidence_invalid FROM r),
w AS (SELECT *, (SELECT count(*) FROM x) - tp AS fn FROM t) SELECT tp, fp, fn, valid_extra, evidence_invalid, {_prf()} FROM w""",
    "strict_unmatched": _STRICT + " SELECT 'c' || k AS chat, 'm' || e AS msg_id, CAST(e AS INT) AS e FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.chat = 'c' || x.k AND r.matched = 'm' || x.e)",
    "assignment_errors": "SELECT 'unknown output' AS error, count(*) AS n FROM orders WHERE o_orderkey % 9 = 0 HAVING count(*) > 0 UNION ALL SELECT 'unknown row', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 HAVING count(*) > 0",
    "best_matches": f"""WITH {_ROWS}, g AS (SELECT 'e' || e AS k, {_GRAMS.format(s="summary")} AS g FROM e UNION ALL SELECT 'a' || a, {_GRAMS.format(s="summary")} FROM a UNION ALL SELECT 'b' || a, {_GRAMS.format(s="'We ' || summary || ', ' || topic")} FROM a),
p AS (SELECT e.e, a.a, x.g AS eg, y.g AS ag, z.g AS bg, len(list_intersect(string_split(lower(replace(e.topic, ' ', '')), ''), string_split(lower(a.summary || ' ' || 'We ' || a.summary || ', ' || a.topic), ''))) > 0 AS named
FROM e JOIN a ON a.chat = e.chat JOIN g x ON x.k = 'e' || e.e JOIN g y ON y.k = 'a' || a.a JOIN g z ON z.k = 'b' || a.a),
s AS (SELECT e, a, round(least(1e0, greatest(len(list_intersect(eg, ag)) / len(list_distinct(list_concat(eg, ag))), 0.7e0 * (len(list_intersect(eg, bg)) / len(list_distinct(list_concat(eg, bg))))) + CASE WHEN named THEN 0.15e0 ELSE 0 END), 9) AS score FROM p)
SELECT a, e, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, e) = 1""",
    "scenario_matches": _SCENES + " SELECT e, scenario, a, effect_met FROM m",
    "scenario_measures": _SCENES + f""" SELECT {_R.format(p="count(a) FILTER (WHERE scenario = 'web_simple_extract')", q="count(*) FILTER (WHERE scenario = 'web_simple_extract')", k=6)} AS extraction_accuracy,
{_R.format(p="count(a) FILTER (WHERE scenario = 'web_fact_update' AND effect_met)", q="count(*) FILTER (WHERE scenario = 'web_fact_update')", k=6)} AS update_correctness,
{_R.format(p="count(a) FILTER (WHERE conflict)", q="count(*) FILTER (WHERE conflict)", k=6)} AS conflict_detection_rate, 0e0 AS conflict_detection_fpr,
CASE WHEN count(a) FILTER (WHERE conflict) > 0 THEN 1e0 ELSE 0e0 END AS conflict_resolution_accuracy,
{_R.format(p="count(*) FILTER (WHERE scenario = 'web_stale_rejection' AND a IS NULL)", q="count(*) FILTER (WHERE scenario = 'web_stale_rejection')", k=6)} AS stale_consistency,
{_R.format(p="count(a) FILTER (WHERE scenario = 'web_cross_session')", q="count(*) FILTER (WHERE scenario = 'web_cross_session')", k=6)} AS cross_session_recall,
{_R.format(p="count(a) FILTER (WHERE scenario = 'web_multi_source_merge')", q="count(*) FILTER (WHERE scenario = 'web_multi_source_merge')", k=6)} AS merge_quality,
{_R.format(p="count(*) FILTER (WHERE scenario = 'web_distractor_tolerance' AND CASE WHEN effect = 'new_decision' THEN a IS NOT NULL ELSE a IS NULL END)", q="count(*) FILTER (WHERE scenario = 'web_distractor_tolerance')", k=6)} AS noise_filter_ratio FROM m""",
    "timings": """WITH k AS (SELECT event_type, CAST(value AS DOUBLE) AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(v), 1) AS mean, round(max(v) FILTER (WHERE k = n // 2), 1) AS median, CASE WHEN count(*) >= 20 THEN round(max(v) FILTER (WHERE k = floor(n * 0.95)), 1) ELSE 0e0 END AS p95, round(max(v), 1) AS max, round(min(v), 1) AS min,
CASE WHEN sum(v) > 0 THEN round(count(*) / (sum(v) / 1000), 2) ELSE 0e0 END AS rate FROM k GROUP BY event_type""",
    "memory_use": "SELECT o_orderstatus, count(*) AS snapshots, round(avg(o_totalprice), 1) AS mean, round(max(o_totalprice), 1) AS peak, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 1) AS final FROM orders GROUP BY o_orderstatus",
    "cluster_separation": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, unnest([0, 1, 2]) AS level FROM embeddings WHERE label IS NOT NULL),
m AS (SELECT id, v, level, CASE level WHEN 0 THEN 0 WHEN 1 THEN label ELSE label * 3 + id % 3 END AS c FROM v),
d AS (SELECT a.level, a.id, a.c = b.c AS own, avg(1 - list_cosine_similarity(a.v, b.v)) AS d FROM m a JOIN m b ON a.level = b.level AND a.id <> b.id GROUP BY ALL),
z AS (SELECT level, count(DISTINCT c) AS topics FROM m GROUP BY level), y AS (SELECT level, max(n) AS largest, sum(n) / count(*) AS per_topic FROM (SELECT level, c, count(*) AS n FROM m GROUP BY ALL) GROUP BY level),
x AS (SELECT level, coalesce(avg(d) FILTER (WHERE own), 0) AS intra, coalesce(avg(d) FILTER (WHERE NOT own), 0) AS inter FROM d GROUP BY level)
SELECT level, topics, largest, round(per_topic, 4) AS per_topic, round(intra, 4) AS intra, round(inter, 4) AS inter, round(inter / greatest(intra, 1e-9), 4) AS ratio FROM x JOIN y USING (level) JOIN z USING (level)""",
    "cluster_granularity": """WITH m AS (SELECT vec_id AS id, vec_id % 9 AS l, CASE WHEN vec_id % 4 > 0 THEN 2 ELSE 1 END AS level FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE l <= 3) AS n_short, count(*) FILTER (WHERE l > 5) AS n_long, coalesce(round(avg(level) FILTER (WHERE l <= 3), 2), 0) AS short_level, coalesce(round(avg(level) FILTER (WHERE l > 5), 2), 0) AS long_level FROM m)
SELECT *, round(short_level - long_level, 2) AS difference FROM s""",
    "token_matches": f"""WITH {_ROWS}, t AS (SELECT 'e' AS side, chat, e AS id, list_distinct(list_concat(regexp_extract_all(lower(summary), '[a-z][a-z0-9]*'), regexp_extract_all(lower(summary), '[0-9]+'))) AS t FROM e UNION ALL SELECT 'a', chat, a, list_distinct(list_concat(regexp_extract_all(lower(summary), '[a-z][a-z0-9]*'), regexp_extract_all(lower(summary), '[0-9]+'))) FROM a)
SELECT DISTINCT x.id AS e FROM t x JOIN t y ON x.side = 'e' AND y.side = 'a' AND x.chat = y.chat WHERE round(len(list_intersect(x.t, y.t)) / least(len(x.t), len(y.t)), 9) >= 0.8""",
    "merged_reports": f"""WITH r AS (SELECT c_custkey % 7 AS tp, c_custkey % 5 AS fp, c_custkey % 3 AS fn FROM customer), f AS (SELECT *, {_R.format(p='2 * tp', q='2 * tp + fp + fn', k=9)} AS f FROM r),
t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(f), 6) AS macro_mean, round(stddev_pop(f), 6) AS macro_stddev, round(min(f), 6) AS macro_min, round(max(f), 6) AS macro_max FROM f) SELECT *, {_prf(6)} FROM t""",
    "repeated_runs": "WITH r AS (SELECT CAST(s_suppkey * 37 % 101 AS DOUBLE) / 100 AS f FROM supplier) SELECT count(*) AS runs, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS stddev, round(min(f), 6) AS min, round(max(f), 6) AS max, round(avg(CASE WHEN f >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS pass_rate FROM r",
    "class_scores": f"""WITH s AS (SELECT event_type AS x, CASE WHEN event_id % 10 < 6 THEN event_type WHEN event_id % 10 < 9 THEN 'view' END AS y FROM events WHERE event_type IN ('click', 'view', 'purchase')),
c AS (SELECT k AS class, count(*) FILTER (WHERE x = k AND y = k) AS tp, count(*) FILTER (WHERE x <> k AND y = k) AS fp, count(*) FILTER (WHERE x = k AND y IS DISTINCT FROM k) AS fn FROM s, unnest(['click', 'view', 'purchase']) t(k) GROUP BY k),
f AS (SELECT *, {_prf(9)} FROM c) SELECT *, round(avg(f1) OVER (), 9) AS macro_f1 FROM f""",
    "run_agreement": "SELECT count(*) AS keys, round(avg(CASE WHEN o_orderkey % 5 = 0 THEN 0e0 ELSE 1e0 END), 9) AS agreement FROM orders",
    "query_report": """WITH o AS (SELECT unnest(['all', o_orderpriority]) AS "group", CAST(o_orderkey * 7919 % 10007 AS DOUBLE) / 10 AS v, CASE WHEN o_orderkey % 3 > 0 THEN 1e0 ELSE 0e0 END AS ok FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY "group") AS n FROM o)
SELECT "group", count(*) AS n, round(avg(ok), 6) AS match_rate, round(avg(v), 4) AS mean, max(v) FILTER (WHERE k = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (WHERE k = least(floor(n * 0.95), n - 1)) AS p95 FROM k GROUP BY "group" """,
    "cluster_purity": "WITH c AS (SELECT vec_id % 9 AS cluster, label, count(*) AS k FROM embeddings GROUP BY ALL) SELECT cluster, CAST(sum(k) AS BIGINT) AS n, CAST(round(max(k) / sum(k), 6) AS DOUBLE) AS purity FROM c GROUP BY cluster",
    "stratified_split": """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(c_custkey * 31 % 97 AS DOUBLE) / 97 AS f, c_custkey % 13 AS t FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY f, c_custkey) AS lo, row_number() OVER (PARTITION BY c_mktsegment ORDER BY f DESC, c_custkey DESC) AS hi FROM c),
m AS (SELECT *, lo <= 2 OR hi <= 2 AS edge FROM r)
SELECT c_custkey, c_mktsegment, CASE WHEN edge OR row_number() OVER (PARTITION BY c_mktsegment, edge ORDER BY t DESC, c_custkey) = 1 THEN 'dev' ELSE 'holdout' END AS part FROM m""",
    "evaluation_gates": _JUDGED + f", t AS (SELECT {_C} FROM j), w AS (SELECT {_prf()} FROM t) SELECT precision >= 0.2 AND recall >= 0.99 AND f1 >= 0.99 AS passed, concat_ws(',', CASE WHEN f1 < 0.99 THEN 'f1' END, CASE WHEN precision < 0.2 THEN 'precision' END, CASE WHEN recall < 0.99 THEN 'recall' END) AS failed FROM w",
    "label_coverage": 'SELECT count(*) AS n, count(*) = count(DISTINCT doc_id) AS "unique", count(DISTINCT quality) FILTER (WHERE quality IN (0, 1)) = 2 AS covered_quality, count(DISTINCT toxic) FILTER (WHERE toxic IN (0, 1, 2)) = 3 AS covered_toxic FROM labels',
    "manifest_overlap": "SELECT c_nationkey AS key, CAST(2 AS BIGINT) AS n FROM (SELECT DISTINCT c_nationkey FROM customer) WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 7)",
}
