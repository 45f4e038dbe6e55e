"""What larger tables showed: repeated keys, copies, groups of one key."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from threadloom.functions.text import bigram_jaccard, blocks
from threadloom.operators import clustering, context, evaluation, graph, lifecycle, likeness, retrieval, search


def test_a_path_with_many_changes_has_one_bridge(spark):
    rows = [("a.go", "go", "nav"), ("a.go", "go", "zzz"), ("b", "", "nav"), ("b", "nav", None), ("c", "", "")]
    df = spark.createDataFrame(rows, "path string, language string, diff string")
    assert sorted(map(tuple, context.bridges(df, ["zzz", "", "Go", "nav"]).collect())) == [("a.go", "zzz", "diff_summary"), ("b", "nav", "language")]


def _jaccard(a, b):
    x, y = ({t[i : i + 2] for i in range(len(t) - 1)} for t in (a.strip().lower(), b.strip().lower()))
    return round(len(x & y) / len(x | y), 9) if x | y else 0.0


def test_similar_new_compares_in_tiles(spark):
    rows = [(k, k % 3 or None, f"Name {k * 37 % 101}" if k % 4 else " ", f"text of {k % 5}") for k in range(120)]
    df = spark.createDataFrame(rows, "id long, topic int, summary string, full_text string").repartition(3)
    found = retrieval.similar_new(df.filter("id % 10 = 1"), df, 0.3)
    assert "BroadcastNestedLoopJoin" not in (plan := found._jdf.queryExecution().toString()) and "aggregate(" not in plan and "FlatMapGroupsInArrow" in plan
    said = lambda r: r[2] if r[2].strip() else r[3]
    want = {(a[0], b[0], _jaccard(said(a), said(b))) for a in rows if a[0] % 10 == 1 for b in rows if a[1] is not None and a[1] == b[1] and a[0] != b[0] and _jaccard(said(a), said(b)) >= 0.3}
    assert want and set(map(tuple, found.collect())) == want


def test_nearest_in_topic_meets_copies_once(spark):
    rng = random.Random(4)
    rows = [(k, k % 4 or None, [rng.gauss(0, 1) for _ in range(6)] if k % 9 else None, f"text {k % 5} of it" if k % 11 else "") for k in range(150)]
    df = spark.createDataFrame(rows, "id long, topic int, vector array<double>, text string").repartition(3)
    found = retrieval.nearest_in_topic(df.filter("id % 3 = 0"), df, 5, 0.8, 0.3)
    assert "aggregate(" not in found._jdf.queryExecution().toString()  # no cosine or likeness of single pairs
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    want = {}
    for i, topic, v, t in rows[::3]:
        others = [r for r in rows if topic is not None and r[1] == topic and r[0] != i]
        near = sorted((-cos(v, r[2]), r[0]) for r in others if v and r[2])[:1]
        if near and -near[0][0] > 0.8:
            want[i] = (near[0][1], round(-near[0][0], 6), "vector")
        elif like := [(r[0], round(_jaccard(t, r[3]), 6), "text") for r in others if _jaccard(t, r[3]) >= 0.3]:
            want[i] = min(like)
    assert {w[2] for w in want.values()} == {"vector", "text"}
    assert {r["id"]: (r["match"], round(r["score"], 6), r["kind"]) for r in found.collect()} == want


def test_chains_that_have_ended_meet_nobody(spark, monkeypatch):
    rows = [(str(k), str(k // 2) if k > 1 and k % 7 else "") for k in range(1, 200)] + [("x", "y"), ("y", "x"), ("z", "none"), ("own", "own"), ("p", "x")]
    df = spark.createDataFrame(rows, "id string, up string").repartition(3)
    met = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda t: (met.append(t), keep(t))[1])
    got = {r["node"]: (r["path"], r["complete"]) for r in graph.paths(df, "id", "up").collect()}
    joined = [t for t in met if t.columns == ["node", "path", "top"]][1:]  # the first are single nodes
    assert joined and all(r["path"][1:] for t in joined for r in t.collect() if r["top"] is None)
    up = {k: u for k, u in rows if u in dict(rows) and u != k}
    for node, (path, complete) in got.items():
        if node in "xyp":
            assert not complete and path[-1] == node
            continue
        want = [node]
        while want[0] in up:
            want.insert(0, up[want[0]])
        assert complete and path == want
    assert len(got) == len(rows)


def test_linkage_grows_with_the_square(spark):
    rng = np.random.default_rng(3)
    for n, places in ((40, 9), (60, 1)):  # with one place there are many ties
        x = rng.normal(size=(n, 3))
        d = np.round(((x[:, None] - x[None]) ** 2).sum(2), places)
        m, size, left = d.copy(), np.ones(n), list(range(n))
        np.fill_diagonal(m, np.inf)
        want = []
        while len(left) > 1:
            i, j = min(((a, b) for a in left for b in left if a < b), key=lambda p: (m[p], p))
            want.append((i, j, round(float(m[i, j]), 6)))
            m[i] = m[:, i] = (size[i] * m[i] + size[j] * m[j]) / (size[i] + size[j])
            m[i, i] = np.inf
            size[i] += size[j]
            left.remove(j)
        assert places < 9 or [(i, j, round(h, 6)) for i, j, h in clustering.linkage(d)] == want
        assert np.allclose(sorted(h for _, _, h in clustering.linkage(d)), sorted(w[2] for w in want), atol=1e-6)
    x = rng.normal(size=(3000, 8))
    began = time.process_time()
    assert len(clustering.linkage(-x @ x.T + 100)) == 2999 and time.process_time() - began < 6


def test_likeness_of_pairs_is_made_in_batches(spark):
    texts = ["", None, "a", "ab", " Ab ", "abab", "决定 👍👍 a", "İx", "Use option 7 for X", "use option 77 for x", "\n"]
    rows = [(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)] * 40  # more than are sorted at once
    df = spark.createDataFrame(rows, "i int, j int, a string, b string").coalesce(1)
    for stripped in (True, False):
        got = df.select("*", likeness.pair_likeness(F.col("a"), F.col("b"), stripped).alias("got"), bigram_jaccard("a", "b", stripped).alias("want")).collect()
        assert all(r["got"] == r["want"] for r in got) and len({r["got"] for r in got}) > 3
    d = spark.createDataFrame([(str(k), f"Use option {k % 4}", "decided", k, 0.5, 1.0) for k in range(9)], "sid string, summary string, status string, version int, confidence double, hot_score double")
    pairs = spark.createDataFrame([(str(a), str(b)) for a in range(9) for b in range(9) if a < b], "id_a string, id_b string")
    found = lifecycle.duplicate_pairs(pairs, d, 0.95)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and plan.count("like(") == 1
    assert {(r["keep"], r["lose"]) for r in found.collect()} == {(str(b), str(a)) for a in range(9) for b in range(9) if a < b and a % 4 == b % 4}


def test_best_matches_make_bigrams_in_batches(spark):
    e = spark.createDataFrame([(1, "c", "T", "keep it"), (2, "c", None, None), (3, "d", "zz", "abc")], "e int, chat string, topic string, summary string")
    a = spark.createDataFrame([(10, "c", "keep it", ""), (11, "c", None, "We keep it"), (12, "d", "xyz", None)], "a int, chat string, summary string, body string")
    best = evaluation.best_matches(e, a, "chat")
    assert "array_intersect" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, best.collect())) == [(10, 1, 1.0), (11, 1, round(0.7 * 6 / 9, 9))]


def test_blocks_cut_a_text_once(spark):
    text = "".join(f"#h{k}\n" for k in range(6000)) + "#end"
    began = time.time()
    got = spark.createDataFrame([(text,), (None,), ("a\n#b",)], "t string").select(blocks(F.col("t"))).collect()
    assert time.time() - began < 10
    assert got[0][0][0] == (0, "heading", "#h0") and got[0][0][-1] == (6000, "content", "#end") and len(got[0][0]) == 6001
    assert got[1][0] == [] and got[2][0] == [(0, "heading", "a"), (1, "content", "#b")]


def test_strict_outcomes_read_messages_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [("c", "m1", "we ship it"), ("c", "m2", "we ship"), ("d", "m1", "no")]
    messages = spark.createDataFrame(rows, "chat string, msg_id string, msg string").mapInPandas(seen, "chat string, msg_id string, msg string")
    expected = spark.createDataFrame([("c", 1, "m1"), ("c", 2, "m2")], "chat string, e int, msg_id string")
    made = [("c", 1, ["m1", "m2"]), ("c", 2, ["m1"]), ("c", 3, ["m2", "m1"]), ("c", 4, ["m1", "m9"]), ("d", 1, ["m1"]), ("d", 2, [])]
    outputs = spark.createDataFrame(made, "chat string, a int, cited array<string>").select("*", F.lit("ship").alias("quote"), F.lit("choice").alias("kind"), F.lit(False).alias("suggestion"), F.lit("decided").alias("status"))
    got = sorted((r.chat, r.a, r.outcome, r.matched) for r in evaluation.strict_outcomes(outputs, expected, messages).collect())
    assert got == [("c", 1, "match_gt", "m1"), ("c", 2, "invalid", ""), ("c", 3, "match_gt", "m2"), ("c", 4, "invalid", ""), ("d", 1, "invalid", ""), ("d", 2, "invalid", "")]
    assert read.value == len(rows)


def test_small_blocks_share_tiles(spark):
    """Many small blocks meet in few tiles, a block over several runs in all of its tiles; pairs are those of plain sets."""
    rng = random.Random(3)
    sets = [("big" if k < 40 else f"b{k % 60}", k, sorted(rng.sample(range(12), rng.randrange(1, 8)) + [2**40 + k % 3])) for k in range(400)]
    df = spark.createDataFrame(sets, "block string, id long, grams array<long>").repartition(3)
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(b, i, j): like(x, y) for b, i, x in sets for c, j, y in sets if b == c and i < j and like(x, y) >= 0.4}
    plan = likeness.like_pairs(df, 0.4)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow [ca#" in plan  # a group of Python for each tile, not for each block of it
    sizes, likeness.RUN = likeness.RUN, 16
    try:
        pairs = {(r.block, r.id_a, r.id_b): r.similarity for r in likeness.like_pairs(df, 0.4).collect()}
        both = {(r.block, r.id, r.other) for r in likeness.like_between(df.filter("id % 3 = 0"), df.withColumn("id", F.col("id").cast("string")), 0.4).collect()}
        links = {(r.block, r.id): r.links for r in likeness.like_counts(df, 0.4).collect()}
    finally:
        likeness.RUN = sizes
    assert pairs.keys() == want.keys() and all(abs(pairs[k] - v) < 1e-9 for k, v in want.items())
    assert both == {(b, i, str(j)) for b, i, x in sets for c, j, y in sets if b == c and i % 3 == 0 and like(x, y) >= 0.4}
    assert links == {(b, i): n for b, i, _ in sets if (n := sum(k[0] == b and i in k[1:] for k in want))}


def test_tiles_send_packed_sets(spark):
    df = spark.range(50).select(F.lit("b").alias("block"), "id", F.sequence(F.lit(2**41), F.lit(2**41 + 99)).alias("grams"))
    tiles = likeness._tiles(df, 0.5)
    assert dict(tiles.dtypes)["packed"] == "binary" and "grams" not in tiles.columns
    assert tiles.agg(F.max(F.length("packed"))).first()[0] < 110


def test_histories_shuffle_messages_once(spark):
    """No message is sent to each of the 30 after it; messages of one moment aren't before each other, those without a moment before none."""
    rng = random.Random(5)
    rows = [(rng.choice(["c", "d", None]), k, rng.choice([*range(25), None]), rng.choice(["", "t", "u", None])) for k in range(240)]
    df = spark.createDataFrame(rows, "chat string, id long, at long, thread string").select("chat", "id", "thread", F.timestamp_seconds("at").alias("ts")).repartition(3)
    got = context.history(df, 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    found = {r.id: (r.thread_history, r.chat_history) for r in got.collect()}
    for chat, k, at, thread in rows:
        past = sorted((t, i, th or "") for c, i, t, th in rows if None not in (c, t, at) and c == chat and t < at)
        mine = [i for _, i, th in past if thread and th == thread][-7:]
        assert found[k] == (mine, [i for _, i, th in past if th in ("", thread)][-7:]), (chat, k, at, thread)


def test_a_task_sorts_only_scores_that_can_stay():
    rng, k = np.random.default_rng(3), 5
    ids, best = np.zeros((64, k), np.int64), np.full((64, k), -np.inf)
    assert search.SCORES_AT_ONCE * 8 <= 2 << 20
    scores, rows = np.round(rng.normal(size=(64, 6000)), 2), rng.permutation(6000)  # with many ties
    scores[0] = np.where(rows < 3, scores[0], -np.inf)  # fewer than k
    scores[1, ::2], scores[2] = np.nan, 0.0
    peaks = []
    for at in range(0, 6000, 2000):
        part, own = scores[:, at : at + 2000], rows[at : at + 2000]
        for here in (np.arange(0, 64, 2), np.arange(1, 64, 2)) if at else (slice(None),):
            met = part[here]
            tracemalloc.start()
            search.better(ids, best, here, met, own)
            peaks.append(tracemalloc.get_traced_memory()[1] / met.nbytes)
            tracemalloc.stop()
    assert max(peaks[1:]) < 1  # merging all scores with those of before and sorting them took several times as much
    for n in range(64):
        want = sorted((-s, i) for s, i in zip(scores[n], rows, strict=True) if s > -np.inf)[:k]
        assert [(-s, i) for s, i in zip(best[n], ids[n], strict=True) if s > -np.inf] == want
