"""Edge cases that the driver's tables don't hold: streams, sources, cycles, empty inputs."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.scores import hot_score, precision_recall_f1
from threadloom.plans import catalog
from threadloom.operators import aggregates, dedup, graph, lifecycle, search, windows
from threadloom.sources import messages
from threadloom.streaming.sessions import first_seen, stream_sessions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_bigrams_and_similarity(spark):
    assert value(spark, T.bigram_jaccard(F.lit(" Abc "), F.lit("abc"))) == 1.0
    assert value(spark, T.bigram_jaccard(F.lit("a"), F.lit("abc"))) == 0.0
    assert value(spark, T.bigram_jaccard(F.lit("abcd"), F.lit("bcde"))) == 0.5
    assert value(spark, T.character_overlap(F.lit("aab"), F.lit("bcd"))) == 1 / 3


def test_noise_rules(spark):
    noise = {None: True, "": True, " ok ": True, "hey": True, "决定": False, "午餐吃什么呢呢": True, "我们决定午餐吃什么": False, "https://a.b/c": True, "https://a.b/c see the plan": False, "we choose B": False}
    rows = spark.createDataFrame(list(noise), "string").select("value", T.is_noise(F.col("value")).alias("v")).collect()
    assert {r["value"]: r["v"] for r in rows} == noise


def test_scores(spark):
    assert value(spark, hot_score(F.lit(5), F.lit(7), F.lit(4), F.lit(0))) == 100.0
    assert value(spark, hot_score(F.lit(0), F.lit(0), F.lit(0), F.lit(90))) == 0.0
    assert value(spark, precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))["f1"]) == 0.0


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted((r["node"], r["depth"]) for r in graph.reachable(edges, start, 6).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted((r["node"], r["depth"]) for r in graph.neighbourhood(edges, start, 1).collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_fold_keeps_the_last_filled_value(spark):
    log = spark.createDataFrame([("d", 1, "draft", "x"), ("d", 2, "", "y"), ("d", 3, None, ""), ("e", 9, "new", None)], "id string, at int, status string, note string")
    state = {r["id"]: r.asDict() for r in lifecycle.fold(log, "id", ["at"], ["status", "note"]).collect()}
    assert (state["d"]["status"], state["d"]["note"], state["d"]["version"], state["d"]["updated_at"]) == ("draft", "y", 3, 3)
    assert [r["id"] for r in lifecycle.as_of(log, "id", ["at"], ["status"], 5).collect()] == ["d"]


def test_fuzzy_pairs_against_all_pairs(spark):
    rows = [(i, "tx"[i % 2], f"decision {'ab' * (i % 5)} number {i // 3}") for i in range(40)] + [(90, "t", ""), (91, "t", None)]
    df = spark.createDataFrame(rows, "id long, topic string, text string")
    grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    sim = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    want = sorted((a[0], b[0]) for a in rows[:40] for b in rows[:40] if a[0] < b[0] and a[1] == b[1] and sim(a[2], b[2]) >= 0.7)
    assert sorted((r["id_a"], r["id_b"]) for r in dedup.fuzzy_pairs(df, "id", "topic", "text", 0.7).collect()) == want


def test_majority_and_best(spark):
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "k string, v string")
    assert {r["k"]: r["winner"] for r in aggregates.majority(votes, ["k"], "v").collect()} == {"a": "x", "b": None}
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "k string, seq int, score int")
    assert aggregates.best_by(rows, ["k"], F.col("score"), F.col("seq")).first()["seq"] == 1


def test_bm25_prefers_the_rarer_term(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta"), (3, "gamma delta"), (4, None), (5, "gamma")], "id long, text string")
    best = search.top(search.bm25(docs, "alpha beta", "id", "text"), 2).collect()
    assert [r["id"] for r in best] == [1, 2]
    assert search.bm25(docs, "absent", "id", "text").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, k string, ts timestamp, text string")
    assert windows.gap_sessions(none, "k", "ts", ["id"], 10).count() == 0
    assert dedup.fuzzy_pairs(none, "id", "k", "text", 0.5).count() == 0
    assert search.bm25(none, "word", "id", "text").count() == 0


def test_stream_agrees_with_batch(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"u{i % 2}", t0 + timedelta(minutes=m)) for i, m in enumerate([0, 1, 10, 12, 100, 101, 300])]
    (tmp_path / "in").mkdir()
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp")
    df.union(df.limit(2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(99, "zz", t0 + timedelta(days=9))], "id long, user string, ts timestamp")  # moves the watermark past all
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_sessions(first_seen(stream, ["id"], "ts"), "user", "ts", late=None).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    streamed = sorted((r["user"], r["begin"], r["n"]) for r in spark.table("found").collect() if r["user"] != "zz")
    assert streamed == sorted((r["user"], r["begin"], r["n"]) for r in stream_sessions(df, "user", "ts").collect())


def test_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"msg_id": "1", "msg": "hi"}\n\n{"msg_id": "2", "expected_decision": false}\n')
    read = messages.read_jsonl(spark, str(tmp_path / "m.jsonl"), "msg_id string, msg string, expected_decision boolean")
    assert [r["msg_id"] for r in messages.expected_rows(read).collect()] == ["1"]
    (tmp_path / "m.txt").write_text("[m1] Ann: hello: you\n\n")
    assert messages.read_messages(spark, str(tmp_path / "m.txt"), "").first().asDict() == {"msg_id": "m1", "speaker": "Ann", "msg": "hello: you"}
    (tmp_path / "d.md").write_text("---\nsid: 7\ntitle: a: b\n---\nBody\nmore")
    row = messages.read_front_matter(spark, str(tmp_path / "d.md")).first()
    assert row["fields"] == {"sid": "7", "title": "a: b"} and row["body"] == "Body\nmore"


def test_all_queries_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(60, 3)).astype(float)  # with ties and zero vectors
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)] + [(60, None), (None, [1.0, 0.0, 0.0])], "id long, vector array<double>").repartition(4)
    found = {}
    for r in search.nearest_each(df, df.filter("id % 5 = 0"), 7).orderBy("query_id", "rank0").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    scores = np.round(search.cosines(x, x), 9)
    assert found == {q: sorted((i for i in range(60) if i != q), key=lambda i: (-scores[i, q], i))[:7] for q in range(0, 60, 5)}
    assert search.nearest_each(df, df.filter("id < 0"), 7).count() == 0


def test_registered_searches_answer_every_query(spark):
    queries = catalog.queries()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id % 50 = 0")
    assert "hybrid_topk_each" in queries and vectors.count() > 1
    assert queries["hybrid_topk_each"](spark, "/root/testdata/sf0.001").select("query_id").distinct().count() == vectors.count()
    assert queries["bm25_topk_each"](spark, "/root/testdata/sf0.001").select("query_id").distinct().count() > 1


def test_every_match_of_a_keyword_is_returned(spark, tmp_path):
    rows = [(i, "All The same" if i % 4 else "none", "en" if i % 3 else "de", None, i) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["keyword_matches"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in found.collect()) == [i for i in range(200) if i % 4 and i % 3]
