import hashlib
import math
import random

import numpy as np
import pytest

from threadloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v string, of string, salt string"


def rows_of(seed, n=300, d=16, spread=40):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-spread, spread) / 4096 + 1e-5 for _ in range(d)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [rows[5], rows[5], (7, rows[9][1], 1), (None, rows[3][1], None), (None, rows[4][1], 2)]  # repeated rows, an id with two vectors, no id
    rows += [(900, None, 1), (901, [None] + rows[0][1][1:], 1), (902, [math.nan] + rows[0][1][1:], 1), (-5, [math.inf] + rows[0][1][1:], 1)]
    rng.shuffle(rows)
    return [(*r, "c", "e", "v", "o", "s") for r in rows]


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    place = lambda i: (1 << 63) - 1 if i is None else i
    firsts = {}
    for i, v, _ in kept:
        firsts[place(i)] = min(firsts.get(place(i), v), v)
    books = [[cut(firsts[i], p) for i in sorted(firsts)[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p, b in enumerate(books):
            own = [[] for _ in b]
            for _, v, _ in kept:
                own[near(cut(v, p), b)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for e, g in zip(b, own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), b) for p, b in enumerate(books)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(s for s, _ in found)))
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    return sorted(((*r, total[r[1]], digest) for r in out), key=str)


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 300, 40), (2, 300, 3), (3, 12, 40), (4, 200, 1)])
def test_as_by_hand(spark, seed, n, spread):
    rows = rows_of(seed, n, spread=spread)
    got = codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_labels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 1)
    rows = rows_of(5)
    assert sorted(map(tuple, codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_no_rows_and_wrong_lengths(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).collect() == []
    with pytest.raises(ValueError, match="from 8 to 16 components"):
        codes.compress(spark.createDataFrame([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], "vec_id long, embedding array<float>, label int"))
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, [0.0] * 9, 1)], "vec_id long, embedding array<float>, label int"))


def test_the_tree_finds_the_nearest_entry_of_lowest_index():
    rng = np.random.default_rng(1)
    for trial in range(60):
        d, spread = int(rng.integers(1, 9)), int(rng.choice([1, 2, 5, 1000, 1 << 24]))
        entries = rng.integers(-spread, spread, (int(rng.integers(1, 40)), d), endpoint=True)
        parts = np.concatenate([rng.integers(-spread, spread, (400, d), endpoint=True), entries])
        square = ((parts[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
        index, best = codes.nearest(codes.vantage_tree(entries.tolist()), entries, parts)
        assert (best == square.min(1)).all() and (index == square.argmin(1)).all(), trial


def test_the_tree_leaves_entries_out():
    """Of well separated entries only a few are compared."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-1000, 1000, (16, 2))
    parts = entries[rng.integers(0, 16, 2000)] + rng.integers(-3, 3, (2000, 2))
    seen = 0
    einsum = np.einsum

    def counted(*a):
        nonlocal seen
        seen += len(a[1])
        return einsum(*a)

    np.einsum = counted
    try:
        codes.nearest(codes.vantage_tree(entries.tolist()), entries, parts)
    finally:
        np.einsum = einsum
    assert seen < 16 * 2000 * 0.6
