import random

import numpy as np

from threadloom.llm import near_dedup
from threadloom.llm.graph import components
from tests.llm.helpers import awkward, awkward_rows, empty, order, prose, shingles


def brute(rows):
    sets = {}
    for r in rows:
        sets.setdefault(order(r[0]), []).append(shingles(r[1]))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted((order(r[0]), len(shingles(r[1])), find(order(r[0])), find(order(r[0])) == order(r[0])) for r in rows)


def got(df):
    return sorted((order(r["doc_id"]), r["n_shingles"], order(r["component_id"]), r["kept"]) for r in df.collect())


def test_against_brute_force(spark):
    assert got(near_dedup.near_duplicates(awkward(spark))) == brute(awkward_rows())


def test_keep_one(spark):
    docs = awkward(spark)
    want = [r for r in brute(awkward_rows()) if r[3]]
    kept = near_dedup.keep_one(docs)
    assert sorted(order(r["doc_id"]) for r in kept.collect()) == [r[0] for r in want]
    assert kept.columns == docs.columns


def test_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(chain).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(1 << 63, size=4000, dtype=np.uint64)
    a, b = pool[:3000], pool[1000:]
    of = lambda s: near_dedup.registers(s, np.array([0, len(s)]))
    assert (near_dedup.merge(of(a), of(b)) == of(pool)).all()
    similar = near_dedup.estimate_jaccard(of(a), of(b), np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(similar - 0.5) < 0.2
    assert near_dedup.estimate_jaccard(of(a), of(a), np.array([3000.0]), np.array([3000.0]))[0] > 0.99


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(2)
    dropped = 0
    for n in (3, 40, 150, 900, 5000):
        for shared in np.unique(np.linspace(n // 2, n, 25).astype(int)):
            pool = np.unique(rng.integers(1 << 63, size=2 * n, dtype=np.uint64))
            a, b = pool[:n], pool[n - shared : 2 * n - shared]
            bits = near_dedup.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            may = near_dedup.may_reach(bits[0], bits[1], len(a), len(b), 75)
            assert may or 100 * shared < 75 * (len(a) + len(b) - shared)
            dropped += not may
    assert dropped > 40


def test_tiles_hold_every_pair_of_different_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)  # one bucket in many tiles
    rng = np.random.default_rng(3)
    base = rng.integers(1 << 63, size=100, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(100) < share, rng.integers(1 << 63, size=100, dtype=np.uint64), base)) for share in rng.choice([0.02, 0.1, 0.2, 0.3], size=60)]
    bits = near_dedup.parity(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
    component = [int(c) for c in rng.integers(3, size=60)]
    placed = spark.createDataFrame([(key, i, 60, component[i]) for key in (5, 9) for i in range(60)], "key long, ord long, size long, component long").repartition(3)
    known = spark.createDataFrame([(i, len(s), bytearray(bits[i].tobytes())) for i, s in enumerate(sets)], "ord long, n long, bits binary")
    found = sorted((r["a"], r["b"]) for r in near_dedup._open_pairs(placed, known, 75).collect())
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if component[i] != component[j] and near_dedup.may_reach(bits[i], bits[j], len(sets[i]), len(sets[j]), 75)]
    assert found == want and 0 < len(want) < 1770


def test_rows_without_an_id_or_with_one_id_are_linked_by_their_own_texts(spark):
    rng = random.Random(9)
    a, b, c, d, e, f, g = (prose(rng, 80, 5000) for _ in range(7))
    rows = [(1, a), (None, a + " end"), (None, b), (None, c), (None, c + " end"), (2, d), (2, e), (3, e + " end"), (3, f), (4, f + " end"), (5, g), (5, g), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()]
    want = [(1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (None, None, False), (None, None, True)]
    want += [(2, 2, True), (2, 2, True), (3, 2, False), (3, 2, False), (4, 2, False), (5, 5, True), (5, 5, True), (6, 6, True)]
    assert sorted(found, key=str) == sorted(want, key=str)
    kept = [tuple(r) for r in near_dedup.keep_one(docs).collect()]
    assert sum(r[1] in (c, c + " end") for r in kept) == 1
    want = [(1, a), (None, b), (2, d), (2, e), (3, f), (5, g), (5, g), (6, None), (None, None)]
    assert sorted((r for r in kept if r[1] not in (c, c + " end")), key=str) == sorted(want, key=str)
