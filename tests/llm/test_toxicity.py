import random

import numpy as np

from threadloom.llm import toxicity
from tests.llm.helpers import awkward, empty, prose


def test_maximal_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        s = np.array([rng.choice([-1.0, -0.25, 0.5, 2.0, -3.0]) for _ in range(rng.randrange(1, 14))])

        def split(lo, hi, s=s):
            best = max(((s[b:e].sum(), -b, -(e - b), b, e) for b in range(lo, hi) for e in range(b + 1, hi + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            top = best[0]
            b, e = max(((e - b, b, e) for b in range(lo, hi) for e in range(b + 1, hi + 1) if abs(s[b:e].sum() - top) < 1e-9 and min(np.cumsum(s[b:e])) > 0 and min(np.cumsum(s[b:e][::-1])) > 0), default=(0, best[3], best[4]))[1:]
            return [*split(lo, b), (b, e), *split(e, hi)]

        got = toxicity.maximal_segments(s)
        total = lambda found: sorted(round(float(s[b:e].sum()), 6) for b, e in found)
        assert total([(b, e) for b, e, _ in got]) == total(split(0, len(s)))


def planted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        text = prose(rng, 150).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["Vile", "wretchedness", "wretcheder", "vile!"]))
        rows.append((i, " ".join(text).replace("w", "abc").replace("x", "y"), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = planted(spark)
    model = toxicity.fit_toxicity(docs, labels.filter("doc_id % 5 <> 0"))
    found = toxicity.score_documents(docs, model).collect()
    held = [r for r in found if r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)
    assert any(r["segments"] for r in found if truth[r["doc_id"]])
    odd = toxicity.score_documents(awkward(spark), model).collect()
    assert len(odd) == awkward(spark).count() and not any(r["predicted"] for r in odd)


def test_one_class_or_nothing(spark):
    docs, labels, _ = planted(spark)
    model = toxicity.fit_toxicity(docs, labels.filter("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(awkward(spark), model).collect())
    assert toxicity.score_documents(empty(spark), model).count() == 0
    assert toxicity.fit_toxicity(empty(spark), labels).weights[0] < 0
