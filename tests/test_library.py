"""Functions, stores, matching, sessions, streams, clusters and files on small cases, some against plain Python."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import detector as D
from threadloom.functions import status as S
from threadloom.functions import text as T
from threadloom.operators import aggregates, clustering, context, evaluation, graph, lifecycle, retrieval, store, windows
from threadloom.sources import messages, records
from threadloom.streaming import episodes as E

T0 = datetime(2024, 1, 1)


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_noise_of_emoji_links_and_comments(spark):
    texts = ["👍👍", "👍 ok then", "https://", "http://a.b  x", "http://a.b and more", "👍👍👍👍👍a", "...", None]
    assert values(spark, texts, T.is_noise) == [True, False, True, True, False, True, True, True]
    assert values(spark, ["LGTM", "+1", " 👍 ", "fine", ""], T.is_noise_for_doc) == [True, True, True, False, True]
    assert values(spark, ["abc", "汉字", "カナ", "é"], T.has_cjk) == [False, True, True, False]
    assert values(spark, ["👍👍a", "👍abc", "", "👍" * 11], T.is_mostly_emoji) == [True, False, False, False]


def test_words_and_overlaps(spark):
    assert values(spark, ["Hello, (World)! a 我们好"], T.extract_words)[0] == ["hello", "world", "我们好", "我们好", "我们", "们好"]
    assert values(spark, ["AbC"], lambda t: T.character_overlap(t, F.lit("abcd"))) == [0.75]
    assert values(spark, ["采用 Redis 7", "x1", ""], lambda t: T.token_overlap(t, F.lit("redis 采用 8"))) == [2 / 3, 0.0, 0.0]
    assert values(spark, ["Use `foo_bar`, MyClass and the api"], T.code_keywords)[0] == ["MyClass", "api", "class", "foo_bar"]
    assert values(spark, ["另外，看这个", "By the way", "no"], T.is_topic_shift) == [True, True, False]
    assert values(spark, ["好吗", "用吗", "why?", "x"], T.is_pure_question) == [True, False, True, False]
    assert values(spark, ["a/b.tar.GZ", ".env", "x/y.py", "x.d/y"], T.extension) == [".gz", "", ".py", ""]
    assert values(spark, ["# A\nx\n# B\ny", "x\n# A", ""], lambda t: T.blocks(t)["content"]) == [["# A\nx", "# B\ny"], ["x", "# A"], []]
    assert values(spark, ['say ```json\n{"a": 1}\n``` ok', 'so {"a": {"b": 2}} .', "none"], T.json_block) == ['{"a": 1}', '{"a": {"b": 2}}', "none"]


def test_detector(spark):
    got = values(spark, ["我们决定采用方案A", "早上好 可能 吃了吗", "hello", ""], D.detect_message)
    assert [(r["level"], r["is_decision"]) for r in got] == [("high", True), ("none", False), ("none", False), ("none", False)]
    assert got[0]["score"] == pytest.approx(0.45 * 1.0 + 0.35 * 0.8 + (0.8 - 0.73) / 2, abs=0.05) and got[1]["anti_score"] == 1.0
    docs = values(spark, ["# 技术选型\n采用：Redis 因为 优点 " * 3], lambda t: D.detect_document(t, F.lit("design")))
    assert docs[0]["level"] == "high" and values(spark, ["# 技术选型 采用：Redis"], lambda t: D.detect_document(t, F.lit("weekly_report")))[0]["level"] == "none"


def test_states(spark):
    assert values(spark, ["completed", "decided", "rejected"], lambda a: S.conflict_status(a, F.lit("decided"))) == ["resolved", "conflict_active", "unknown"]
    assert values(spark, ["weak", "strong"], lambda a: S.stronger(a, F.lit("medium"))) == ["medium", "strong"]
    assert values(spark, ["v1.9", "v2", "", "vx.y"], S.next_version) == ["v1.10", "v2.1", "v1.1", "v1.1"]
    assert values(spark, ["v1.9", ""], lambda v: S.next_version(v, True)) == ["v2.0", "v1.0"]


def test_bare_tables(spark):
    d = spark.createDataFrame([], "n long, sid string, project string, topic_id string, status string, impact_level string, title string, summary string, full_text string, parent_id string, hot_score double, confidence double, version long, chat_id string, created_at timestamp")
    r = spark.createDataFrame([], "src string, type string, dst string")
    for found in (store.by_topic(d, "p", "t"), store.timeline(d), store.hot(d, 1.0), store.forgotten(d, 1.0, 5), store.topics(d, "p"), store.related(d, r), store.conflicts(d, r), store.conflicts_of(d, r, d), store.equal_summaries(d), store.topic_rollup(d, r), store.for_output(d), graph.paths(d, "sid", "parent_id"), graph.preorder(d, "sid", "parent_id"), graph.subtrees(d, "sid", "parent_id", "status"), lifecycle.promoted(d), lifecycle.kept_conflicts(spark.createDataFrame([], "source string, target string"), d)):
        assert found.count() == 0
    assert store.statistics(d).count() <= 1 and store.cross_topic(d, r, "p", "t").count() == 0


def test_trees_with_cycles_and_lost_parents(spark):
    rows = [("a", ""), ("b", "a"), ("c", "b"), ("d", "b"), ("e", "e"), ("f", "gone"), ("x", "y"), ("y", "x"), ("g", None)]
    df = spark.createDataFrame(rows, "sid string, parent string").withColumn("label", F.upper("sid"))
    paths = {r["node"]: (r["path"], r["complete"]) for r in graph.paths(df, "sid", "parent").collect()}
    assert {k: paths[k] for k in "abcdefg"} == {"a": (["a"], True), "b": (["a", "b"], True), "c": (["a", "b", "c"], True), "d": (["a", "b", "d"], True), "e": (["e"], True), "f": (["f"], True), "g": (["g"], True)}
    assert not paths["x"][1] and not paths["y"][1]
    trees = {r["node"]: json.loads(r["tree"]) for r in graph.subtrees(df.filter("sid NOT IN ('x', 'y')"), "sid", "parent", "label").collect()}
    assert set(trees) == {"a", "e", "f", "g"}
    leaf = lambda x: {"id": x, "label": x.upper(), "children": []}
    assert trees["a"] == {"id": "a", "label": "A", "children": [{"id": "b", "label": "B", "children": [leaf("c"), leaf("d")]}]}
    assert [r["node"] for r in graph.preorder(df.filter("sid IN ('a', 'b', 'c', 'd', 'e')"), "sid", "parent").orderBy("place").collect()] == ["a", "b", "c", "d", "e"]
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else "") for i in range(30)], "sid string, parent string")
    assert graph.paths(deep, "sid", "parent").agg(F.max("depth")).first()[0] == 29


def test_greedy_against_a_loop(spark):
    rng = random.Random(3)
    pairs = [(f"c{rng.randrange(4)}", rng.randrange(12), rng.randrange(12), rng.choice([0.3, 0.5, 0.5, 0.9])) for _ in range(300)]
    pairs = list({(c, l, r): (c, l, r, s) for c, l, r, s in pairs}.values())
    want, used = set(), set()
    for c, l in sorted({(p[0], p[1]) for p in pairs}):
        free = [p for p in pairs if p[:2] == (c, l) and (c, p[2]) not in used]
        if free:
            best = min(free, key=lambda p: (-p[3], p[2]))
            used.add((c, best[2]))
            want.add(best)
    found = evaluation.greedy(spark.createDataFrame(pairs, "chat string, l int, r int, score double").repartition(3))
    assert {tuple(x) for x in found.collect()} == want


def test_matching_rules(spark):
    e = spark.createDataFrame([("c", 1, "t", "abcdef", False, "decided"), ("c", 2, "t", "abcxyz", True, "decided"), ("c", 3, "u", "qqq", False, "decided")], "chat string, e int, topic string, summary string, suggestion boolean, status string")
    a = spark.createDataFrame([("c", 1, "t", "abcdeg", False, "decided"), ("c", 2, "general", "abcxyz", True, "pending"), ("c", 3, "v", "other", False, "decided"), ("c", 4, "", "more", False, "decided"), ("d", 5, "u", "qqq", False, "decided")], "chat string, a int, topic string, summary string, suggestion boolean, status string")
    m = evaluation.matched(e, a)
    assert sorted((r["l"], r["r"]) for r in m.collect()) == [(1, 1), (2, 2)]
    row = evaluation.metrics(evaluation.judged(e, a, m)).first()
    assert (row["tp"], row["fp"], row["fn"], row["topic_accuracy"], row["status_accuracy"]) == (2, 1, 1, 0.5, 0.5)


def test_merges_keep_what_is_new(spark):
    d = spark.createDataFrame([("a", "one", 0.2, 1, "decided"), ("b", "one two three", 0.9, 4, "pending"), ("c", "xyz", 0.1, 2, "pending"), ("d", None, 0.5, 1, "pending")], "sid string, full_text string, confidence double, version int, status string")
    out = {r["sid"]: (r["full_text"], r["confidence"], r["version"], r["status"]) for r in lifecycle.merge_pairs(spark.createDataFrame([("a", "b"), ("a", "c")], "keep string, lose string"), d).collect()}
    assert out == {"a": ("one two three\n\nxyz", 0.9, 5, "decided"), "b": ("one two three", 0.9, 4, "superseded"), "c": ("xyz", 0.1, 2, "superseded"), "d": (None, 0.5, 1, "pending")}
    chain = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("x", "c", 0.7)], "keep string, lose string, similarity double")
    assert [tuple(r) for r in lifecycle.chosen_losers(chain).collect()] == [("a", "b")]


def test_diversity_against_a_loop(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    rows = [(q, i, i, [float(v) for v in x[i]]) for q in (0, 1) for i in range(q * 20, q * 20 + 20)]
    found = {(r["query_id"], r["id"]) for r in retrieval.diverse(spark.createDataFrame(rows, "query_id int, id int, rank int, vector array<double>"), 0.8).collect()}
    want = set()
    for q in (0, 1):
        kept = []
        for i in range(q * 20, q * 20 + 20):
            if all(x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) <= 0.8 for j in kept):
                kept.append(i)
        want |= {(q, i) for i in kept}
    assert found == want


def session_rows(seed=4, n=120):
    rng, at, rows = random.Random(seed), {}, []
    for i in range(n):
        chat = f"u{rng.randrange(3)}"
        at[chat] = at.get(chat, 0) + rng.choice([5, 20, 400, 4000])
        v = [1.0, 0.0] if rng.random() < 0.5 else [0.0, 1.0] if rng.random() < 0.5 else None
        rows.append((chat, i, T0 + timedelta(seconds=at[chat]), rng.choice(["one thing", "By the way two", "three things"]), v))
    return rows


MESSAGES = "chat string, id long, ts timestamp, text string, vector array<double>"


def test_episodes_end_where_rules_say(spark):
    rows = [("u", 1, 0, "a", [1.0, 0.0]), ("u", 2, 10, "b", [1.0, 0.1]), ("u", 3, 20, "c", [0.0, 1.0]), ("u", 4, 30, "d", [1.0, 0.0]), ("u", 5, 5000, "e", [1.0, 0.0]), ("u", 6, 5010, "by the way f", None), ("u", 7, 5020, "g", None)]
    df = spark.createDataFrame([(c, i, T0 + timedelta(seconds=s), t, v) for c, i, s, t, v in rows], MESSAGES)
    got = [(r["id"], r["episode"], r["why"]) for r in E.episodes(df).orderBy("id").collect()]
    assert got == [(1, 0, "new"), (2, 0, "append"), (3, 1, "diversion:new"), (4, 0, "diversion:reopened"), (5, 0, "gap:reopened"), (6, 2, "shift:new"), (7, 2, "append")]
    chat = E.Chat(E.Rules(idle=30.0, duration=7200.0))
    chat.add(0.0, "x", None)
    assert (chat.timer(10), chat.timer(30), E.Chat(E.Rules()).timer(9e9)) == (None, "idle", None)
    for i in range(30):
        chat.suspend(float(i))
        chat.add(float(i), "x", None)
    assert len(chat.pool) == 20


def test_streamed_episodes_are_those_of_the_table(spark, tmp_path):
    df = spark.createDataFrame(session_rows(), MESSAGES)
    for k in range(3):
        df.filter(f"id >= {k * 40} AND id < {k * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df.limit(0).coalesce(1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = E.stream_episodes(stream, late="30 days").writeStream.format("memory").queryName("episodes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    order = lambda rows: sorted((r["chat"], r["id"], r["episode"], r["why"]) for r in rows)
    assert order(spark.table("episodes").collect()) == order(E.episodes(df).collect())


def test_micro_groups_against_a_loop(spark):
    rng, rows, at = random.Random(8), [], 0
    for i in range(80):
        at += rng.choice([1, 5, 15])
        rows.append(("u", i, T0 + timedelta(seconds=at), rng.choice(["", "", "t1"]), " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=2))))
    found = {r["id"]: r["grp"] for r in E.micro_groups(spark.createDataFrame(rows, "chat string, id long, ts timestamp, thread string, text string")).collect()}
    want, n, last, words = {}, -1, None, set()
    for _, i, ts, thread, text in rows:
        if thread:
            want[i] = "t:t1"
            continue
        own = set(text.split())
        if last is None or (ts - last).total_seconds() > 10 or not own & words:
            n, words = n + 1, set()
        words |= own
        last, want[i] = ts, f"g:{n}"
    assert found == want


def test_linkage_and_clusters(spark):
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.7], [0.9, 0.7, 0]])
    assert [(i, j, round(h, 9)) for i, j, h in clustering.linkage(d)] == [(0, 1, 0.1), (0, 2, 0.8)]
    rows = [("p", i, [1.0, 0.02 * i]) for i in range(3)] + [("p", 10 + i, [0.02 * i, 1.0]) for i in range(3)] + [("q", 7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "block string, id long, vector array<double>")
    found = {(r["block"], r["id"]): r["cluster"] for r in clustering.clusters(df, threshold=0.5).collect()}
    assert found == {**{("p", i): 0 for i in range(3)}, **{("p", 10 + i): 10 for i in range(3)}, ("q", 7): 7}
    tree = {(r["level"], r["cluster"]): r["parent"] for r in clustering.containment_tree(clustering.clusters(df.filter("block = 'p'"), 2)).collect()}
    assert tree[(0, 0)] is None and all(p == 0 for (level, _), p in tree.items() if level)


def test_settled_conflicts_with_nulls_and_ties(spark):
    d = spark.createDataFrame([("a", "", "A", None, "decided", "minor", 0.4, ["x"], 5), ("b", "t", None, "text b", "pending", "major", None, None, 2), ("c", None, "C", "c", "pending", None, 0.9, ["y", "x"], 1)], "sid string, topic_id string, summary string, full_text string, status string, impact_level string, confidence double, tags array<string>, version int")
    clash = spark.createDataFrame([("m", "a", "b"), ("m", "c", "a"), ("n", "a", "zz"), ("", "a", "b"), (None, "a", "b"), ("c", "c", "b")], "sid string, source string, target string")
    got = {r["sid"]: tuple(r)[1:] for r in lifecycle.settle_conflicts(d, clash).collect()}
    assert got == {
        "a": ("", "A", None, "decided", "minor", 0.4, ["x"], 5),
        "b": ("t", None, "text b", "superseded", "major", None, None, 2),
        "m": ("t", "A; ", "\n---\ntext b", "decided", "minor", 0.4, ["x"], 1),
        "c": ("t", "C; ", "c\n---\ntext b", "decided", "major", 0.9, ["x", "y"], 1),
    }
    assert lifecycle.settle_conflicts(d.limit(0), clash).count() == 0


def overlap(x, y):
    x, y = set((x or "").strip().lower()), set((y or "").strip().lower())
    return round(len(x & y) / max(len(x), len(y)), 9) if x and y else 0.0


def test_rows_without_a_chat_match_in_any(spark):
    expected = [(None, 1, "t", "use grpc now", False, "decided"), ("c", 2, " t ", "use grpc", False, "decided")]
    found = [("c", 7, "t", "use grpc", False, "decided"), ("d", 8, "t ", "use grpc now", False, "decided")]
    e, a = (spark.createDataFrame(rows, f"chat string, {n} long, topic string, summary string, suggestion boolean, status string") for rows, n in ((expected, "e"), (found, "a")))
    m = evaluation.matched(e, a)
    assert {(r["chat"], r["l"], r["found_chat"], r["r"]) for r in m.collect()} == {(None, 1, "d", 8), ("c", 2, "c", 7)}
    assert {r["outcome"] for r in evaluation.judged(e, a, m).collect()} == {"tp"}
    # without a nameless row topics are still stripped
    m = evaluation.matched(e.filter("e = 2"), a)
    assert [(r["l"], r["r"]) for r in m.collect()] == [(2, 7)]


def test_matching_against_one_at_a_time(spark):
    rng = random.Random(12)
    words = ["use", "grpc", "redis", "cache", "friday", "决定", "部署", "é"]
    row = lambda i: (rng.choice(["c", "d", "", None]), i, rng.choice(["t", " t", "u", "general", "", None]), " ".join(rng.choices(words, k=rng.randrange(0, 4))), rng.choice([True, False, None]), "decided")
    expected, found = [row(i) for i in range(40)], [row(i) for i in range(45)]
    taken, want = set(), {}
    for chat, i, topic, summary, sug, _ in expected:
        best, score = None, 0.0
        for k, (chat2, j, topic2, summary2, sug2, _) in enumerate(found):
            t, t2 = (topic or "").strip(), (topic2 or "").strip()
            if k in taken or (chat and chat2 and chat != chat2) or (t and t2 and t2 != "general" and t != t2):
                continue
            s = overlap(summary, summary2)
            if s >= (0.3 if bool(sug) == bool(sug2) else 0.45) and s > score:
                best, score = k, s
        if best is not None:
            taken.add(best)
            want[i] = found[best][1]
    e, a = (spark.createDataFrame(rows, f"chat string, {n} long, topic string, summary string, suggestion boolean, status string").repartition(3) for rows, n in ((expected, "e"), (found, "a")))
    m = evaluation.matched(e, a)
    assert {r["l"]: r["r"] for r in m.collect()} == want
    outcomes = [r["outcome"] for r in evaluation.judged(e, a, m).collect()]
    assert (outcomes.count("tp"), outcomes.count("fn")) == (len(want), 40 - len(want))


def test_segments_around_decisions(spark):
    rows = [("c", i, t, d) for i, (t, d) in enumerate([("x", False), ("x", True), ("x", False), ("x", False), ("y", False)])]
    out = windows.segments(spark.createDataFrame(rows, "k string, i int, topic string, decision boolean"), "k", ["i"], "topic", "decision")
    assert [r["segment"] for r in out.orderBy("i").collect()] == [1, 2, 3, 3, 4]
    newest = aggregates.keep_newest(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, t string"), ["k"], ["v"])
    assert sorted((r["k"], r["v"], r["t"]) for r in newest.collect()) == [("a", 2, "y"), ("b", 1, None)]


def test_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("[m1] Ann: hello: you\nnoise\n[m2] 李：好\n\n")
    assert [tuple(r) for r in messages.read_messages(spark, str(tmp_path / "m.txt"), "").collect()] == [("m1", "Ann", "hello: you"), ("m2", "李", "好")]
    rows = spark.createDataFrame([("s1", "p", "t a", "---\nsid: s1\n---\nbody 1"), ("s2", "p", "u", "---\nsid: s2\n---\nbody 2\nmore")], "sid string, project string, topic string, text string")
    records.write_markdown(rows, str(tmp_path / "md"))
    back = records.read_decisions(spark, str(tmp_path / "md"), "p").collect()
    assert sorted((r["topic"], r["fields"]["sid"], r["body"].rstrip("\x00")) for r in back) == [("t a", "s1", "body 1"), ("u", "s2", "body 2\nmore")]
    assert [r["topic"] for r in records.listed_topics(spark, str(tmp_path / "md"), "p").collect()] == ["t a", "u"]
    (tmp_path / "loose.md").write_text("# title\nkey: a\nno pair\nother: b: c\nkey: d\n")
    assert records.read_loose(spark, str(tmp_path / "loose.md")).first()["fields"] == {"other": "b: c", "key": "d"}
    v = spark.createDataFrame([("s1", "p", "t", "x"), ("s2", "q", "t", "y")], "sid string, project string, topic string, status string")
    for _ in range(2):
        records.append_versions(v, str(tmp_path / "v"))
    table = spark.read.parquet(str(tmp_path / "v"))
    assert sorted((r["sid"], r["version"]) for r in table.collect()) == [("s1", 1), ("s1", 2), ("s2", 1), ("s2", 2)]
    assert {r["version"] for r in records.latest_versions(table).collect()} == {2}
    records.archive_project(spark, str(tmp_path / "v"), str(tmp_path / "old"), "p")
    assert spark.read.parquet(str(tmp_path / "old")).count() == 2
    records.write_graph(str(tmp_path / "g"), topics=v, episodes=v.limit(1))
    assert records.read_graph(spark, str(tmp_path / "g"), "topics", "episodes")["topics"].count() == 2
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    before = spark.createDataFrame(records.file_snapshot(spark, str(tmp_path / "src")).collect())
    (tmp_path / "src" / "a.py").write_text("y")
    (tmp_path / "src" / "b.py").write_text("z")
    kinds = {r["path"][-4:]: r["change_type"] for r in records.file_changes(before, records.file_snapshot(spark, str(tmp_path / "src"))).collect()}
    assert kinds == {"a.py": "modified", "b.py": "created"}
    pair = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    assert tuple(records.line_changes(pair("a\nb\nc"), pair("a\nd")).first()) == ("f", 1, 2)
    s = spark.createDataFrame([(i, "ab"[i % 2], T0 + timedelta(days=i)) for i in range(6)], "id int, source string, ts timestamp")
    assert [r["id"] for r in records.snapshots(s, 3, "b").collect()] == [5, 3] and records.keep_newest_snapshots(s, 1).count() == 2
    m = spark.createDataFrame([("c2", 1), ("c1", 2), ("c3", 3)], "chat_id string, i int")
    own, _ = records.select_chats(m, m, sample=2)
    assert sorted(r["chat_id"] for r in own.collect()) == ["c1", "c2"] and records.selection_hash(own) == records.selection_hash(own.repartition(3)) != records.selection_hash(m)
    merged = records.merged_ontology(pair("old").union(spark.createDataFrame([("g", "kept")], "path string, text string")), pair("new"), ["path"])
    assert sorted(tuple(r) for r in merged.collect()) == [("f", "new"), ("g", "kept")]


def test_history_without_rows_and_tiers(spark):
    m = spark.createDataFrame([("c", 1, T0, None), ("c", 2, T0, None), ("c", 3, T0 + timedelta(seconds=1), "t")], "chat string, id long, ts timestamp, thread string")
    assert {r["id"]: (r["thread_history"], r["chat_history"]) for r in context.history(m, 1).collect()} == {1: ([], []), 2: ([], []), 3: ([], [2])}


def test_rollups_with_nulls_ties_and_empty_tables(spark):
    from threadloom.operators import rollups as R

    schema = "chat string, id long, speaker string, topic string, at long, expected string"
    rows = [("a", 2, "y", "t2", 20, "TRUE"), ("a", 1, "x", "t1", None, None), ("a", 3, "y", None, 30, "false"), (None, 1, "", "", None, None), (None, 1, "", "", None, None)]
    got = {r["chat"]: tuple(r)[1:] for r in R.chat_rollup(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (3, 1, ["x", "y"], "t1", 20), None: (2, 0, [], "general", None)}
    assert R.chat_rollup(spark.createDataFrame([], schema)).count() == 0
    memo = "type string, hits long, created_at long"
    assert R.memo_stats(spark.createDataFrame([], memo)).count() == 0
    assert sorted(map(tuple, R.memo_stats(spark.createDataFrame([("k", None, 5), ("k", 2, 3)], memo)).collect())) == [("all", 2, 2, 3, 5), ("k", 2, 2, 3, 5)]
    assert R.dimension_accuracy(spark.createDataFrame([], "dimension string, correct boolean"), ["d"]).collect()[0]["accuracy"] == 0.0
