"""Average linkage in rounds, exact selection and separation by sums, against plain Python over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import clustering, selection
from threadloom.sources import scratch


def vectors(seed, n, d=5, blocks=("p",)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((rng.choice(blocks), i, [rng.gauss(0, 1) for _ in range(d)], rng.choice([1.0, 2.0, 4.0, 9.0, 15.0])))
    rows += [(rows[0][0], n + k, rows[0][2], rows[0][3]) for k in range(n // 3)]  # a third are copies
    rows += [(rows[1][0], 10 * n, [0.0] * d, 2.0), (rows[1][0], 10 * n + 1, [2 * x for x in rows[1][2]], rows[1][3])]
    rng.shuffle(rows)
    return rows


def brute(rows, levels, weighted):
    """{(block, level, id): cluster} and the sorted heights of each block."""
    found, all_heights = {}, {}
    for block in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == block), key=lambda r: r[1])
        x = np.array([r[2] for r in own], float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        d = 1 - u @ u.T
        if weighted:
            lengths = np.array([r[3] for r in own])
            w = np.clip(lengths / lengths.mean(), 0.5, 2.0)
            for i in range(len(own)):
                for j in range(len(own)):
                    if w[i] < 1 and w[j] < 1:
                        d[i, j] *= 2 - math.sqrt(w[i] * w[j])
                    elif w[i] > 1 and w[j] > 1:
                        d[i, j] /= math.sqrt(w[i] * w[j])
        steps = clustering.linkage(np.maximum(np.round(d, 9), 0))
        heights = sorted(h for _, _, h in steps)
        all_heights[block] = heights
        m = len(heights)
        if m == 0:
            cuts = [0.0] * levels
        elif m <= levels:
            cuts = sorted((heights[k] for k in np.linspace(0, m - 1, levels, dtype=int)), reverse=True)
        else:
            cuts = [heights[-1] + 0.01, *[heights[int(p * (m - 1))] for p in np.linspace(0.9, 0.1, levels - 1)]]
        for level, cut in enumerate(cuts):
            home = list(range(len(own)))
            for i, j, h in steps:
                if h <= cut + 1e-7:
                    a, b = home[i], home[j]
                    home = [min(a, b) if c in (a, b) else c for c in home]
            for i, c in enumerate(home):
                found[block, level, own[i][1]] = own[c][1]
    return found, all_heights


@pytest.mark.parametrize(("seed", "n", "most", "levels", "weighted", "blocks"), [(1, 90, 12, 4, False, ("p",)), (2, 90, 12, 3, True, ("p",)), (3, 120, 20, 3, True, ("p", "q", "r")), (4, 60, 500, 4, False, ("p", "q")), (5, 6, 3, 9, False, ("p", "q"))])
def test_the_same_tree_as_one_merge_at_a_time(spark, seed, n, most, levels, weighted, blocks):
    rows = vectors(seed, n, blocks=blocks)
    df = spark.createDataFrame(rows, "block string, id long, vector array<double>, length double").repartition(3)
    df = df if weighted else df.drop("length")
    want, heights = brute(rows, levels, weighted)
    made = {}
    for r in clustering.merges(df, most).collect():
        made.setdefault(r["block"], []).append(r["height"])
    for block, own in heights.items():
        assert np.allclose(sorted(made.get(block, [])), own, atol=1e-6)
    got = {(r["block"], r["level"], r["id"]): r["cluster"] for r in clustering.clusters(df, levels, None, most).collect()}
    assert got == want


def test_no_more_clusters_in_a_task_than_its_share(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([("p", i, [float(c) for c in v]) for i, v in enumerate(x)], "block string, id long, vector array<double>")
    taken = []
    monkeypatch.setattr(clustering, "_SHARE", 24)
    given = clustering._merged
    monkeypatch.setattr(clustering, "_merged", lambda wide, near, *more: taken.append(near.select(F.explode(F.array("i", "j"))).distinct().count()) or given(wide, near, *more))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = sorted((r["i"], r["j"]) for r in clustering.merges(df, 9).collect())
    assert found == sorted(m[:2] for m in nearest_first(np.maximum(np.round(1 - x @ x.T, 9), 0))) and max(taken) <= 25


def test_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [("p", i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(rows, "block string, id long, vector array<double>")
    tables = []
    monkeypatch.setattr(clustering, "written", lambda df: tables.append(df) or scratch.written(df))
    made = sorted((r["height"], r["i"], r["j"]) for r in clustering.merges(df, 128).collect())
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((h, i, j) for i, j, h in clustering.linkage(np.maximum(np.round(1 - x @ x.T, 9), 0)))
    assert [m[1:] for m in made] == [w[1:] for w in want] and np.allclose([m[0] for m in made], [w[0] for w in want], atol=1e-6)
    assert len(tables) <= 3 + 4 * 4  # a round writes its pairs, where they end, its merges and the clusters left


@pytest.mark.parametrize(("dims", "n"), [(3, 40), (40, 40)])
def test_equal_distances(spark, dims, n):
    # unit vectors and sums of two of them: few distances, each of very many pairs
    rng = random.Random(dims)
    x = {tuple(float(k in at) for k in range(dims)) for at in ({rng.randrange(dims) for _ in range(rng.choice((1, 2)))} for _ in range(n))}
    df = spark.createDataFrame([("p", i, list(v)) for i, v in enumerate(sorted(x))], "block string, id long, vector array<double>")
    found = sorted((r["i"], r["j"], r["height"]) for r in clustering.merges(df, 2).collect())
    u = np.array(sorted(x)) / np.linalg.norm(np.array(sorted(x)), axis=1, keepdims=True)
    assert found == sorted(nearest_first(np.maximum(np.round(1 - u @ u.T, 9), 0)))


def nearest_first(d):
    """Merges of average linkage, the nearest pair of all each time, of equal ones the smallest."""
    members, out = [[k] for k in range(len(d))], []
    while len(members) > 1:
        h, a, b = min((max(0.0, round(float(d[np.ix_(p, q)].mean()), 9)), a, b) for a, p in enumerate(members) for b, q in enumerate(members) if a < b)
        out.append((members[a][0], members[b][0], h))
        members[a] = sorted(members[a] + members[b])
        del members[b]
    return out


def test_merges_up_to_a_height():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(np.round(1 - x @ x.T, 9), 0, None)
    i, j = np.triu_indices(len(x), 1)
    signs, want = clustering._signs(7, 6), nearest_first(d)
    for t in (0.0, 0.2, 0.6, 0.9, np.inf):
        near = d[i, j] <= t
        mean, size = np.hstack([np.ones((len(x), 1)), x]), np.ones(len(x), int)
        got = clustering.merged_up_to(mean, size, i[near], j[near], d[i, j][near], signs, t, -1 if np.isinf(t) else len(x))
        some = [w for w in want if w[2] <= t]
        assert [g[:2] for g in got] == [w[:2] for w in some] and np.allclose([g[2] for g in got], [w[2] for w in some], atol=1e-6)
        assert size.sum() == len(x) and (size > 0).sum() == len(x) - len(some)


def test_vectors_that_are_no_numbers(spark):
    df = spark.createDataFrame([("p", i, [math.inf if i >> k & 1 else 1.0 for k in range(3)]) for i in range(1, 8)], "block string, id long, vector array<double>")
    with pytest.raises(ValueError, match="distance"):
        clustering.merges(df, 2)


def test_rows_left_out_and_no_rows(spark):
    schema = "block string, id long, vector array<double>"
    rows = [(None, 1, [1.0, 0.0]), ("p", None, [1.0, 0.0]), ("p", 3, None), ("p", 4, [1.0, 0.0]), ("p", 4, [1.0, 0.0])]
    assert {(r["block"], r["level"], r["id"], r["cluster"]) for r in clustering.clusters(spark.createDataFrame(rows[:4], schema)).collect()} == {("p", k, 4, 4) for k in range(3)}
    assert clustering.clusters(spark.createDataFrame([], schema)).collect() == []
    assert clustering.topic_hierarchy(spark.createDataFrame([], schema)).collect() == []


def test_hierarchy(spark):
    rows = vectors(7, 80)
    df = spark.createDataFrame(rows, "block string, id long, vector array<double>, length double")
    want, _ = brute(rows, 4, True)
    topics = {r["topic"]: r for r in clustering.topic_hierarchy(df, 4, 15).collect()}
    members = {}
    for (_, level, i), c in want.items():
        members.setdefault(f"hier_topic_l{level}_c{c}", set()).add(i)
    assert set(topics) == set(members)
    vector = {r[1]: np.array(r[2]) for r in rows}
    children = {}
    for name, r in topics.items():
        assert r["n"] == len(members[name])
        mean = np.mean([vector[i] for i in members[name]], axis=0)
        assert np.allclose(r["centroid"], mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-12 else r["centroid"])
        if r["level"]:
            assert members[name] <= members[r["parent"]] and topics[r["parent"]]["level"] == r["level"] - 1
            children[r["parent"]] = children.get(r["parent"], 0) + 1
        else:
            assert r["parent"] is None
    assert {n: r["children"] for n, r in topics.items()} == {n: children.get(n, 0) for n in topics}


def test_values_at_ranks(spark):
    rng = random.Random(8)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(3000)], "b": [7.5] * 500 + [rng.random() for _ in range(100)], "c": [1e308, -1e308, 0.0, 5e-324, -5e-324], "d": [3.0], "e": [float(rng.randrange(4)) for _ in range(1000)]}
    rows = [(k, v) for k, own in groups.items() for v in own] + [("a", None), ("a", math.nan), (None, 1.0), ("f", None)]
    rng.shuffle(rows)
    targets = [(k, r) for k, own in groups.items() for r in {0, len(own) // 2, len(own) - 1, len(own) * 95 // 100, len(own), -1}] + [("f", 0), ("g", 0)]
    got = selection.values_at(spark.createDataFrame(rows, "k string, v double").repartition(4), "k", "v", spark.createDataFrame(targets, "k string, rank long"))
    want = {(k, r): sorted(groups[k])[r] for k, r in targets if k in groups and 0 <= r < len(groups[k])}
    assert {(r["k"], r["rank"]): r["v"] for r in got.collect()} == want


def test_values_at_ranks_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_TARGETS", 0)
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") * 37 % 1000).cast("double").alias("v"))
    targets = spark.createDataFrame([("0", 10), ("1", 200), ("2", 332)], "k string, rank long")
    own = {k: sorted(i * 37 % 1000 for i in range(1000) if i % 3 == int(k)) for k in "012"}
    assert {(r["k"], r["rank"]): r["v"] for r in selection.values_at(df, "k", "v", targets).collect()} == {("0", 10): own["0"][10], ("1", 200): own["1"][200], ("2", 332): own["2"][332]}
