import math
import random

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from threadloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, w string, rank string, score string, anchor string"


def rows_of(seed, n=400, d=6, spread=9, labels=3):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-spread, spread) / 256 + 1e-5 for _ in range(d)], rng.randrange(labels)) for i in range(n)]
    hot = [0.03] * d
    rows += [(n + i, hot, i % labels) for i in range(n // 2)]  # a third of all rows are copies
    rows += [rows[30], rows[30], (None, hot, 1), (5000, hot, None), (5001, None, 1), (5002, [None] * d, 1), (5003, [math.nan] + hot[1:], 0)]
    rng.shuffle(rows)
    return [(*r, "i", "v", "w", "r", "s", "a") for r in rows]


def brute(rows, every=20, positives=5, k=10, low=30, high=90):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in kept:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), i, other) for i, u, other in kept)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            window = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(window[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "spread", "labels"), [(1, 400, 9, 3), (2, 400, 2, 2), (3, 60, 200, 5), (4, 100, 1, 1), (5, 150, 400, 10)])
def test_as_by_hand(spark, seed, n, spread, labels):
    rows = rows_of(seed, n, spread=spread, labels=labels)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_small_blocks_and_digits(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "_CELLS", 500)
    rows = rows_of(6, 200)
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(2), F.col("vec_id") % 20 == 0).collect())) == brute(rows)


def test_ids_far_apart(spark):
    far = [(1 << 63) - 1, -(1 << 63), 1 << 62, 0, -1, -(1 << 62)]
    rows = [(i, [0.1, 0.1], k % 2) for k, i in enumerate(far * 4)] + [(20 * k, [0.1, 0.05], k % 2) for k in range(40)] + [(20 * k + 1, [0.1, 0.06], k % 2) for k in range(60)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_no_rows_no_anchors_wrong_lengths(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert negatives.mine(table([]), F.col("vec_id") % 20 == 0).collect() == []
    assert negatives.mine(table([(1, [0.1], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    assert negatives.mine(table([(20, [0.1], 1)]), F.col("vec_id") % 20 == 0).collect() == []
    with pytest.raises(ValueError, match="from 1 to 2 components"):
        negatives.mine(table([(1, [0.1], 1), (2, [0.1, 0.2], 1)]), F.col("vec_id") % 20 == 0)
    with pytest.raises(PythonException, match="or more in size"):
        negatives.mine(table([(1, [1e30], 1)]), F.col("vec_id") % 20 == 0).collect()
