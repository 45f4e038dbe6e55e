"""Queries over messages, documents and files in context, and the detector."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import detector as D
from threadloom.functions import text as T
from threadloom.operators import context, documents_json, splitting
from threadloom.plans.base import ACTIVE, DECISIONS, decisions, read
from threadloom.sources.scratch import spread


def _messages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("chat"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("thread"), F.col("event_type").alias("sender"), F.col("props").alias("text"))


def detected_messages(spark, sf_dir):
    """How much every turn reads like a decision."""
    c = read(spark, sf_dir, "conversations")
    c = c.select("conv_id", "turn", "role", F.concat(F.when(F.col("conv_id") % 3 == 0, F.lit("Decision 1. approved, owner is Ann: ")).when(F.col("conv_id") % 3 == 1, F.lit("maybe ")).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"))
    d = D.detect_message(F.col("text"), F.col("role") == "assistant", F.lit(False), F.col("turn").cast("int"), F.array(F.lit("the"), F.lit("of")))
    return c.select("conv_id", "turn", "role", F.md5("text").alias("digest"), d.alias("d")).select("conv_id", "turn", "role", "digest", "d.score", "d.level", "d.is_decision", "d.anti_score")


def detected_documents(spark, sf_dir):
    """The kind of every document and how much it reads like a decision."""
    t = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("# 决定 Option A: owner todo ")).otherwise(""), F.coalesce("text", F.lit(""))).alias("text"), F.when(F.col("doc_id") % 7 == 0, "Weekly notes").when(F.col("doc_id") % 7 == 1, "Spec of it").otherwise("Text").alias("title"))
    t = t.withColumn("kind", T.document_type(F.col("title"), F.col("text")))
    return t.select("doc_id", "kind", D.detect_document(F.col("text"), F.col("kind")).alias("d")).select("doc_id", "kind", "d.score", "d.level", "d.is_decision")


def message_words(spark, sf_dir):
    """Words and tests of words of every turn."""
    c = read(spark, sf_dir, "conversations")
    t, fixed = F.coalesce("text", F.lit("")), F.lit("the anyway of 2024 (data) pull request my-repo")
    return c.select(
        "conv_id",
        "turn",
        "role",
        F.md5(t).alias("digest"),
        F.size(T.extract_words(t)).cast("long").alias("n_words"),
        T.shares_word(t, fixed).alias("shares"),
        F.round(T.token_overlap(t, fixed), 9).alias("overlap"),
        F.size(T.matching(t, T.CODE_KEYWORDS)).cast("long").alias("n_code"),
        T.is_topic_shift(t).alias("shift"),
        T.is_pure_question(t).alias("question"),
        T.is_noise_for_doc(t).alias("doc_noise"),
        T.has_cjk(t).alias("cjk"),
        T.is_mostly_emoji(t).alias("mostly_emoji"),
        F.round(T.bigram_jaccard(t, fixed, stripped=False), 9).alias("unstripped"),
        T.quote_found(F.substring(t, 3, 20), t).alias("quoted"),
    )


def message_history(spark, sf_dir):
    """The last 30 messages before each, of its thread and of its chat."""
    h = context.history(_messages(spark, sf_dir))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return h.select("chat", "id", ids("thread_history").alias("thread_history"), F.size("chat_history").cast("long").alias("n"), F.md5(ids("chat_history")).alias("chat_history"))


def changes_before(spark, sf_dir):
    """How many of a user's purchases lie in the day before each of its other events."""
    m = _messages(spark, sf_dir)
    return context.within(m.filter("sender = 'purchase'").select("chat", F.col("ts").alias("at")), m.filter("sender <> 'purchase'").select("chat", F.col("ts").alias("moment")), 86400.0).select("chat", F.unix_micros(F.col("moment").cast("timestamp")).alias("moment"), "n")


def message_evidence(spark, sf_dir):
    """The turn that best backs what a conversation's last assistant turn says."""
    c = read(spark, sf_dir, "conversations").filter("turn IS NOT NULL").select(F.col("conv_id").alias("chat"), F.col("turn").alias("id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    d = c.filter("role = 'assistant'").groupBy("chat").agg(F.max(F.struct("id", "text")).alias("l")).select(F.concat(F.lit("s"), F.col("chat").cast("string")).alias("sid"), "chat", F.col("l.text").alias("summary"))
    return context.best_evidence(d, c).select("sid", F.col("id").cast("long").alias("id"), "score")


def file_bridges(spark, sf_dir):
    """Pages as files, bridged to words of a conversation."""
    p = read(spark, sf_dir, "pages")
    path = F.concat(F.coalesce("url", F.lit("")), F.lit("f"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".md", ".go", ".png", "")]), (F.col("page_id") % 5 + 1).cast("int")))
    files = p.select(path.alias("path"), T.language_of(path).alias("language"), F.col("html").alias("diff"))
    return context.bridges(files, ["zzz", "Go", "Markdown", "nav", "7"])


def file_kinds(spark, sf_dir):
    """What the paths of files say."""
    p = read(spark, sf_dir, "pages")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/a", "node_modules/b", "docs/.git/c")]), (F.col("page_id") % 3 + 1).cast("int")), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".py", ".MD", ".tar.gz", ".png", "")]), (F.col("page_id") % 5 + 1).cast("int")))
    return p.select("page_id", T.extension(path).alias("extension"), T.language_of(path).alias("language"), T.is_binary(path).alias("binary"), T.is_watched(path, [".py", ".md", ".png"]).alias("watched"), T.is_significant(F.when(F.col("page_id") % 10 == 0, "deleted").otherwise("modified"), path, F.lit("h"), F.col("page_id") % 20).alias("significant"))


def block_search(spark, sf_dir):
    """The five blocks of each document, a block a line, that hold some words most often."""
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("doc"), F.explode(T.blocks(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n#")))).alias("b")).select("doc", "b.*")
    return context.relevant_blocks(d, "the of in a is").select("doc", F.col("place").cast("long").alias("place"), "kind", "score")


def document_chunks(spark, sf_dir):
    """Documents in overlapping pieces of 1,024 characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"), 1024, 64)).alias("c")).select("doc_id", "c.*")
    return d.select("doc_id", F.col("place").cast("long").alias("place"), F.col("begin").cast("long").alias("begin"), F.md5("content").alias("content"))


def split_documents(spark, sf_dir):
    """Documents cut at the seams of Markdown, plain text or code, in pieces of 512 characters at most."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(F.array(F.lit("markdown"), F.lit("text"), F.lit("python")), (F.col("doc_id") % 3 + 1).cast("int")).alias("language"))
    return splitting.split_texts(d, "doc_id", "text", "language", 512, 32).select("doc_id", "place", "begin", "end", F.md5("content").alias("content"))


def json_leaves(spark, sf_dir):
    """The values in JSON of events, some of it broken, with times by the names of fields."""
    e = read(spark, sf_dir, "events")
    iso = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(F.lit('{"event":{"props":'), "props", F.lit(',"created_at":"'), iso, F.lit('","note":"'), iso, F.lit('"},"tags":["a",["'), "event_type", F.lit('"]],"n":null'))
    j = e.select("event_id", F.concat(text, F.when(F.col("event_id") % 50 == 0, "").otherwise("}")).alias("j"))
    return documents_json.leaves(j, "event_id", "j").select("event_id", "path", "field", "value", F.unix_micros("at").alias("at"), F.col("error").isNotNull().alias("broken"))


def context_tiers(spark, sf_dir):
    """The first five documents of each source: those that hold a phrase, then long ones, then others."""
    d = read(spark, sf_dir, "documents").filter("source IS NOT NULL")
    return context.tiers(d, "source", [F.contains("text", F.lit("token")), F.col("n_chars") > 2000], ["doc_id"]).select("source", "doc_id", F.col("tier").cast("long").alias("tier"))


def participant_topics(spark, sf_dir):
    """The first nation that supplies each order: the topic a chat shares a participant with."""
    chats = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chat"), F.col("l_suppkey").alias("person")).distinct()
    return context.first_overlap(chats, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("topic"), F.col("s_suppkey").alias("person")))


def entity_context(spark, sf_dir):
    """Parts that each supplier delivered in some orders, and those only in others, as entities of now and of the past."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chat"), F.col("l_partkey").alias("name"), "l_orderkey")
    m = context.merged_entities(l.filter("l_orderkey % 4 = 0"), l.filter("l_orderkey % 4 <> 0"))
    return m.groupBy("chat", "local").agg(F.count("*").alias("n"), F.sum("name").alias("names"))


def conversation_texts(spark, sf_dir):
    """Every user's events as a text."""
    return context.conversation_text(_messages(spark, sf_dir), 20).select("chat", "n", F.md5("text").alias("text"))


def context_budget(spark, sf_dir):
    """Active decisions of a chat, then its other ones, under a budget."""
    d = decisions(spark, sf_dir).withColumnRenamed("sid", "id").select("chat_id", "id", "created_at", "n", "status")
    a = d.filter(F.col("status").isin(["decided", "executing"]))
    return context.under_budget(a, d.filter("status = 'shelved'"), "chat_id", ["n"], 9_000).select("chat_id", "kind", "id", F.col("spent").cast("long").alias("spent"))


def time_values(spark, sf_dir):
    """Epochs in seconds and milliseconds as times."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1000 + 1_600_000_000).cast("double").alias("s"))
    return e.select("event_id", F.unix_seconds(T.epoch_time(F.col("s"))).alias("from_s"), F.unix_millis(T.epoch_time(F.col("s") * 1000 + 7)).alias("from_ms"))


def answers(spark, sf_dir):
    """Answers of a model, read as keys, as JSON and as hashes."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" b) "), F.col("p_name"))).when(k % 4 == 1, F.concat(F.lit("The answer is C, "), F.col("p_name"))).when(k % 4 == 2, "").otherwise(F.col("p_name"))
    text = F.concat(F.when(k % 2 == 0, F.lit("Sure:\n```json\n")).otherwise(F.lit("Result: ")), F.format_string('{"n": %d}', k), F.when(k % 2 == 0, F.lit("\n``` done")).otherwise(F.lit(" .")))
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        T.normalise_answer(raw, F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("answer"),
        F.from_json(T.json_block(text), "n long")["n"].alias("n"),
        T.stable_hash(k.alias("k"), F.col("p_name").alias("name")).alias("hash"),
        T.memo_key(F.lit("c"), T.content_hash(F.col("p_name")), T.code_fingerprint(F.lit("def f(): \n  pass\t\n")), F.array(F.lit("b"), F.lit("a"))).alias("memo"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        detected_messages, detected_documents, message_words, message_history, changes_before, message_evidence, file_bridges, file_kinds, block_search, document_chunks, split_documents, json_leaves,
        context_tiers, participant_topics, entity_context, conversation_texts, context_budget, time_values, answers,
    )
}


def _any(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in dict.fromkeys(w.lower() for w in words)) + ")"


def _category(tests):
    n = " + ".join(f"CAST({t} AS INT)" for t, _ in tests)
    return f"least(1e0, greatest(0e0, {', '.join(f'CASE WHEN {t} THEN {w}e0 ELSE 0e0 END' for t, w in tests)}) + CASE WHEN {n} >= 3 THEN 1e-1 ELSE 0e0 END)"


def _re(p):
    return p.replace("'", "''")


_LEX = _category([(_any("l", w), x) for w, x in D.LEXICAL])
_STRUCT = _category([(_any("l", D.LISTS), 0.4), (_any("l", D.OPTIONS), 0.35), ("(contains(t, '\"') OR contains(t, '「') OR contains(t, '『'))", 0.2), (f"(length(t) > 50 AND {_any('l', D.TECHNICAL)})", 0.35), (_any("l", D.ASSIGNMENTS), 0.45)])
_PAT = _category([(f"regexp_matches(t, '{_re(p)}')", w) for p, w in D.PATTERNS])
_DOC_PAT = _category([(f"regexp_matches(t, '{_re(p)}')", w) for p, w in D.DOC_PATTERNS])
_MOSTLY = r"(length(t) BETWEEN 1 AND 10 AND 2 * length(regexp_replace(t, '[^\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{2615}]', '', 'g')) > length(t))"
_QUESTION = f"(regexp_matches(t, '[?？吗吧么]$') AND NOT {_any('l', ['决定', '确认', '通过', '用', '选'])})"
_ANTI = "least(1e0, round(" + " + ".join([*(f"CASE WHEN {_any('l', w)} THEN {x}e0 ELSE 0e0 END" for w, x in D.AGAINST), f"CASE WHEN {_MOSTLY} THEN 5e-1 ELSE 0e0 END", f"CASE WHEN {_QUESTION} THEN 3e-1 ELSE 0e0 END", f"CASE WHEN {_any('l', D.SMALL_TALK)} AND length(t) < 20 THEN 5e-1 ELSE 0e0 END"]) + ", 9))"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
_WORDS = "list_filter(list_transform(regexp_split_to_array({t}, '\\s+'), lambda x: lower(regexp_replace(x, '^[.,!?;:\"''()\\[\\]{{}}]+|[.,!?;:\"''()\\[\\]{{}}]+$', '', 'g'))), lambda x: length(x) >= 2)"
_FIXED = "'the anyway of 2024 (data) pull request my-repo'"
_TOKENS = "list_distinct(list_concat(regexp_extract_all(lower({t}), '[a-z][a-z0-9]*'), regexp_extract_all(lower({t}), '[0-9]+')))"
_GRAMS = "list_distinct([lower({t})[i : i + 1] FOR i IN range(1, length({t}))])"

ORACLE = {
    "detected_messages": f"""
WITH c AS (SELECT conv_id, turn, role, CASE conv_id % 3 WHEN 0 THEN 'Decision 1. approved, owner is Ann: ' WHEN 1 THEN 'maybe ' ELSE '' END || coalesce(text, '') AS raw FROM conversations),
s AS (SELECT *, {_STRIP.format(t='raw')} AS t, lower({_STRIP.format(t='raw')}) AS l FROM c),
x AS (SELECT *, {_LEX} AS lex, {_STRUCT} AS str, {_PAT} AS pat, {_ANTI} AS ag, {_category([("role = 'assistant'", 0.35), ('coalesce(turn, 0) > 2', 0.25), ("(contains(l, 'the') AND contains(l, 'of'))", 0.3)])} AS dyn FROM s),
y AS (SELECT *, 45e-2 * lex + 15e-2 * str + 5e-2 * dyn + 35e-2 * pat AS base FROM x),
z AS (SELECT *, CASE WHEN t = '' OR ag >= 0.6 THEN 0e0 ELSE round(greatest(0e0, least(1e0, CASE WHEN pat >= 0.7 AND base < pat THEN (base + pat) / 2 ELSE base END * (1 - 0.5 * ag))), 9) END AS score FROM y)
SELECT conv_id, turn, role, md5(raw) AS digest, score, CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'none' END AS level, score >= 0.5 AS is_decision, ag AS anti_score FROM z""",
    "detected_documents": f"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '# 决定 Option A: owner todo ' ELSE '' END || coalesce(text, '') AS raw, CASE doc_id % 7 WHEN 0 THEN 'weekly_report' WHEN 1 THEN 'spec' ELSE 'unknown' END AS kind FROM documents),
s AS (SELECT *, {_STRIP.format(t='raw')} AS t, lower({_STRIP.format(t='raw')}) AS l FROM c),
x AS (SELECT *, {_LEX} AS lex, {_STRUCT} AS str, {_DOC_PAT} AS pat, 2e-1 * (CAST(kind = 'weekly_report' AS INT) + CAST(length(t) < 50 AND NOT {_any('l', D.DOC_SIGNALS)} AS INT) + CAST({_any('l', D.MINOR_EDITS)} AS INT) + CAST({_any('l', D.OPEN_POINTS)} AS INT)) AS ag FROM s),
z AS (SELECT *, CASE WHEN t = '' OR ag >= 0.59999 OR kind = 'weekly_report' THEN 0e0 ELSE round(greatest(0e0, least(1e0, (4e-1 * lex + 2e-1 * str + 35e-2 * pat) * (1 - 2e-1 * ag))), 9) END AS score FROM x)
SELECT doc_id, kind, score, CASE WHEN score >= 0.45 THEN 'high' WHEN score >= 0.3 THEN 'medium' WHEN score >= 0.15 THEN 'low' ELSE 'none' END AS level, score >= 0.3 AS is_decision FROM z""",
    "message_words": f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
w AS (SELECT *, lower({_STRIP.format(t='t')}) AS s, {_WORDS.format(t='t')} AS w, {_TOKENS.format(t='t')} AS k, {_TOKENS.format(t=_FIXED)} AS f, CASE WHEN length(t) < 2 THEN [] ELSE {_GRAMS.format(t='t')} END AS g, {_GRAMS.format(t=_FIXED)} AS h FROM c)
SELECT conv_id, turn, role, md5(t) AS digest, len(w) AS n_words, list_has_any(w, {_WORDS.format(t=_FIXED)}) AS shares, CAST(CASE WHEN len(k) = 0 THEN 0 ELSE round(len(list_intersect(k, f)) / least(len(k), len(f)), 9) END AS DOUBLE) AS overlap,
CAST({' + '.join(f"CAST(contains(lower(t), '{k}') AS INT)" for k in T.CODE_KEYWORDS)} AS BIGINT) AS n_code, {' OR '.join(f"starts_with(s, '{k}')" for k in T.TOPIC_SHIFTS)} AS shift, {_QUESTION.replace('(t,', '(s,').replace('(l,', '(s,')} AS question,
s IN ('', 'lgtm', '+1', '👍', '好的', '收到') AS doc_noise, regexp_matches(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]') AS cjk, {_MOSTLY} AS mostly_emoji,
CAST(CASE WHEN len(g) = 0 THEN 0 ELSE round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 9) END AS DOUBLE) AS unstripped, true AS quoted FROM w""",
    "message_history": """
WITH m AS (SELECT user_id AS chat, event_id AS id, ts, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS thread FROM events),
p AS (SELECT a.chat, a.id, a.thread, b.id AS h, b.ts, b.thread AS bt FROM m a JOIN m b ON a.chat = b.chat AND b.ts < a.ts),
t AS (SELECT chat, id, string_agg(h, ',' ORDER BY ts, h) AS v FROM (SELECT * FROM p WHERE thread <> '' AND bt = thread QUALIFY row_number() OVER (PARTITION BY chat, id ORDER BY ts DESC, h DESC) <= 30) GROUP BY ALL),
c AS (SELECT chat, id, count(*) AS n, string_agg(h, ',' ORDER BY ts, h) AS v FROM (SELECT * FROM p WHERE bt = '' OR bt = thread QUALIFY row_number() OVER (PARTITION BY chat, id ORDER BY ts DESC, h DESC) <= 30) GROUP BY ALL)
SELECT m.chat, m.id, coalesce(t.v, '') AS thread_history, coalesce(n, 0) AS n, md5(coalesce(c.v, '')) AS chat_history FROM m LEFT JOIN t ON t.chat = m.chat AND t.id = m.id LEFT JOIN c ON c.chat = m.chat AND c.id = m.id""",
    "changes_before": """
SELECT a.user_id AS chat, epoch_us(a.ts) AS moment, count(b.event_id) AS n FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'purchase' AND epoch_us(a.ts) - epoch_us(b.ts) BETWEEN 0 AND 86400000000 - 1
WHERE a.event_type <> 'purchase' GROUP BY a.event_id, a.user_id, a.ts""",
    "message_evidence": r"""
WITH c AS (SELECT conv_id AS chat, turn AS id, role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
d AS (SELECT chat, arg_max(text, (id, text)) AS summary FROM c WHERE role = 'assistant' GROUP BY chat),
k AS (SELECT d.chat, id, list_distinct(string_split(lower(regexp_replace(summary, '\s+', '', 'g')), '')) AS x, list_distinct(string_split(lower(regexp_replace(text, '\s+', '', 'g')), '')) AS y FROM d JOIN c ON c.chat = d.chat),
s AS (SELECT chat, id, CASE WHEN len(x) < 3 THEN 0 ELSE CAST(round(len(list_intersect(x, y)) / len(x), 9) AS DOUBLE) END AS score FROM k)
SELECT 's' || chat AS sid, id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY chat ORDER BY score DESC, id) = 1 AND score >= 0.6""",
    "json_leaves": """
WITH j AS (SELECT event_id, event_id % 50 = 0 AS broken, '{"event":{"props":' || props || ',"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","note":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"},"tags":["a",["' || event_type || '"]],"n":null}' AS j, epoch_us(date_trunc('second', ts)) AS z FROM events WHERE props IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
t AS (SELECT event_id, t.fullkey AS path, t.key, json_extract_string(t.atom, '$') AS value, g.z FROM (SELECT * FROM j WHERE NOT broken) g, json_tree(g.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))
SELECT event_id, path, CASE WHEN starts_with(path, '$.tags') THEN 'tags' ELSE key END AS field, value, CASE WHEN path = '$.event.created_at' THEN z END AS "at", false AS broken FROM t UNION ALL SELECT event_id, '$', '', NULL, NULL, true FROM j WHERE broken""",
    "file_bridges": """
WITH p AS (SELECT coalesce(url, '') || 'f' || ['.py', '.md', '.go', '.png', ''][page_id % 5 + 1] AS path, ['python', 'markdown', 'go', '', ''][page_id % 5 + 1] AS language, html AS diff FROM pages),
k AS (SELECT * FROM (VALUES (0, 'zzz'), (1, 'go'), (2, 'markdown'), (3, 'nav'), (4, '7')) v(i, k)),
f AS (SELECT path, i, k, CASE WHEN contains(lower(path), k) THEN 'file_path' WHEN language = k THEN 'language' WHEN contains(lower(coalesce(diff, '')), k) THEN 'diff_summary' END AS kind FROM p, k)
SELECT path, k AS keyword, kind FROM f WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY i) = 1""",
    "file_kinds": """
WITH p AS (SELECT page_id, page_id % 3 AS f, ['.py', '.md', '.gz', '.png', ''][page_id % 5 + 1] AS extension FROM pages)
SELECT page_id, extension, CASE extension WHEN '.py' THEN 'Python' WHEN '.md' THEN 'Markdown' ELSE '' END AS language, extension IN ('.gz', '.png') AS "binary", f = 0 AND extension IN ('.py', '.md') AS watched,
page_id % 10 = 0 OR (extension NOT IN ('.gz', '.png') AND page_id % 20 > 10) AS significant FROM p""",
    "block_search": """
WITH p AS (SELECT doc_id AS doc, string_split(replace(coalesce(text, ''), chr(10), chr(10) || '#'), chr(10) || '#') AS p FROM documents WHERE coalesce(text, '') <> ''),
b AS (SELECT doc, len(p) AS n, i, CASE WHEN i = 1 THEN p[1] ELSE '#' || p[i] END AS content FROM (SELECT doc, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
s AS (SELECT doc, i - 1 AS place, CASE WHEN i < n THEN 'heading' ELSE 'content' END AS kind, CAST((length(content) - length(replace(lower(content), 'the', ''))) / 3 + (length(content) - length(replace(lower(content), 'of', ''))) / 2 + (length(content) - length(replace(lower(content), 'in', ''))) / 2 + (length(content) - length(replace(lower(content), 'is', ''))) / 2 + CASE WHEN i < n THEN 5 ELSE 0 END AS BIGINT) AS score FROM b)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, place) <= 5""",
    "document_chunks": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, CASE WHEN length(t) <= 1024 THEN 1 ELSE CAST(ceil((length(t) - 64) / 960.0) AS BIGINT) END AS n FROM d),
i AS (SELECT doc_id, t, unnest(range(0, n)) AS place FROM n)
SELECT doc_id, place, place * 960 AS begin, md5(substring(t, place * 960 + 1, 1024)) AS content FROM i""",
    "context_tiers": """
SELECT source, doc_id, CAST(CASE WHEN contains(text, 'token') THEN 0 WHEN n_chars > 2000 THEN 1 ELSE 2 END AS BIGINT) AS tier FROM documents WHERE source IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source ORDER BY tier, doc_id) <= 5""",
    "participant_topics": "SELECT l_orderkey AS chat, CAST(min(s_nationkey) AS BIGINT) AS topic FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey",
    "entity_context": """
WITH l AS (SELECT l_suppkey AS chat, l_partkey AS name, bool_or(l_orderkey % 4 = 0) AS local FROM lineitem GROUP BY ALL)
SELECT chat, local, count(*) AS n, CAST(sum(name) AS BIGINT) AS names FROM l GROUP BY chat, local""",
    "conversation_texts": """
SELECT user_id AS chat, count(*) AS n, md5(string_agg(event_type || ': ' || CASE WHEN length(coalesce(props, '')) <= 20 THEN coalesce(props, '') ELSE left(props, 17) || '...' END, chr(10) ORDER BY ts, event_id)) AS text FROM events GROUP BY user_id""",
    "context_budget": f"""
WITH {DECISIONS}, x AS (SELECT chat_id, CASE WHEN status = 'shelved' THEN 'result' ELSE 'decision' END AS kind, sid AS id, n, CASE WHEN status = 'shelved' THEN 200 ELSE 100 END AS cost FROM d WHERE status IN ('decided', 'executing', 'shelved')),
s AS (SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY chat_id ORDER BY kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent FROM x)
SELECT chat_id, kind, id, spent FROM s WHERE spent < 9000""",
    "time_values": "SELECT event_id, event_id * 1000 + 1600000000 AS from_s, (event_id * 1000 + 1600000000) * 1000 + 7 AS from_ms FROM events",
    "answers": """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 3 THEN CASE WHEN left(upper(p_name), 1) IN ('A', 'B', 'C') THEN left(upper(p_name), 1) WHEN list_has_any(regexp_split_to_array(upper(p_name), '[^A-Z0-9]+'), ['A', 'B', 'C']) THEN list_filter(['A', 'B', 'C'], lambda x: list_contains(regexp_split_to_array(upper(p_name), '[^A-Z0-9]+'), x))[1] ELSE left(upper(p_name), 1) END END AS answer, p_partkey AS n,
sha256('{"k":' || p_partkey || ',"name":"' || p_name || '"}') AS hash,
'{"component":"c","input_hash":"' || left(sha256(p_name), 16) || '","code_fingerprint":"' || left(sha256('def f():' || chr(10) || '  pass' || chr(10)), 16) || '","dependencies":["a","b"]}' AS memo FROM part""",
}
