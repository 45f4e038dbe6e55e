import hashlib
import random

import pytest

from threadloom.llm import mixing
from tests.llm.helpers import DOCS, awkward, empty, words


SUPPLIES = [(("a", "en", "s1"), 100), (("a", "en", "s2"), 10), (("a", "de", "s1"), 1000), (("b", "en", "s3"), 1000)]


def budgets(spark, supplies, weights, budget, epochs=1):
    path = ["x", "y", "z"][: len(supplies[0][0])]
    df = spark.createDataFrame([(*k, float(n)) for k, n in supplies], ", ".join(f"{p} string" for p in path) + ", supply double").repartition(3)
    return {tuple(r[p] for p in path): r["budget"] for r in mixing.leaf_budgets(df, path, weights, epochs, budget).collect()}


def brute_budgets(supplies, weights, budget, epochs, depth=0):
    """The common level of budget per weight is found by bisection, family by family."""
    if not supplies[0][0][depth:]:
        return {supplies[0][0]: budget}
    families = {}
    for k, n in supplies:
        families.setdefault(k[: depth + 1], []).append((k, n))

    def capacity(rows, d):
        if not rows[0][0][d:]:
            return sum(n for _, n in rows) * epochs
        parts = {}
        for k, n in rows:
            parts.setdefault(k[: d + 1], []).append((k, n))
        return sum(capacity(r, d + 1) for k, r in parts.items() if weights.get(k, 1.0) > 0)

    caps = {k: capacity(r, depth + 1) if weights.get(k, 1.0) > 0 else 0 for k, r in families.items()}
    budget, lo, hi = min(budget, sum(caps.values())), 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(caps[k], mid * weights.get(k, 1.0)) for k in caps) < budget else (lo, mid)
    out = {}
    for k, r in families.items():
        out |= brute_budgets(r, weights, min(caps[k], hi * weights.get(k, 1.0)), epochs, depth + 1)
    return out


def test_shortage_goes_to_siblings_before_ancestors(spark):
    # en of a gives 110 of its 200; the rest goes to de, its sibling, so b keeps its share
    assert budgets(spark, SUPPLIES, {("a",): 1.0, ("b",): 1.0}, 800) == {("a", "en", "s1"): 100, ("a", "en", "s2"): 10, ("a", "de", "s1"): 290, ("b", "en", "s3"): 400}


def test_shortage_of_a_family_goes_up(spark):
    got = budgets(spark, SUPPLIES, {}, 2100)
    assert got[("b", "en", "s3")] == 1000 and sum(got.values()) == pytest.approx(2100)


def test_zero_weights_take_nothing(spark):
    assert budgets(spark, [(("a",), 10), (("b",), 10)], {("a",): 0.0, ("b",): 0.0}, 20) == {("a",): 0.0, ("b",): 0.0}


def test_what_a_family_of_weight_zero_could_give_is_no_capacity(spark):
    got = budgets(spark, [(("a", "en"), 100), (("a", "de"), 1000), (("b", "en"), 1000)], {("a", "de"): 0.0}, 800)
    assert got == {("a", "en"): 100, ("a", "de"): 0, ("b", "en"): 700}


def test_budgets_against_bisection(spark):
    rng = random.Random(7)
    for _ in range(4):
        supplies = [((f"d{i}", f"l{j}", f"s{k}"), rng.choice([0, 3, 50, 1000])) for i in range(3) for j in range(rng.randrange(1, 4)) for k in range(rng.randrange(1, 5))]
        weights = {k[: 1 + rng.randrange(3)]: rng.choice([0.0, 0.5, 2.0, 7.0]) for k, _ in supplies if rng.random() < 0.5}
        budget = rng.random() * sum(n for _, n in supplies)
        got, want = budgets(spark, supplies, weights, budget, 2), brute_budgets(supplies, weights, budget, 2)
        assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def brute_prefix(rows, rest, whole, seed):
    key = lambda r: (hashlib.md5(f"{seed}:{whole}:{'?' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1] is not None, hashlib.md5((r[1] or "").encode()).hexdigest())
    used, taken = 0, []
    for r in sorted(rows, key=key):
        if used < rest and used + len(words(r[1])) / 2 <= rest:
            taken.append(r)
        used += len(words(r[1]))
    return taken


@pytest.mark.parametrize("epochs,share", [(1, 0.4), (3, 1.7), (2, 2.0), (1, 1.0)])
def test_prefixes(spark, monkeypatch, epochs, share):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    docs = awkward(spark)
    rows = [tuple(r) for r in docs.collect()]
    mixed = mixing.mix(docs, share=share, epochs=epochs, seed=4).collect()
    leaves = {}
    for r in rows:
        source = r[3]
        domain = "other" if source is None else f"domain{int(source[3:]) % 4}"
        leaves.setdefault((domain, r[2] or "?", source or "?"), []).append(r)
    supplies = [(k, sum(len(words(r[1])) for r in v)) for k, v in sorted(leaves.items())]
    planned = brute_budgets(supplies, {}, share * sum(n for _, n in supplies), epochs)
    want = {}
    for leaf, tokens in planned.items():
        supply = sum(len(words(r[1])) for r in leaves[leaf])
        whole = min(epochs, int((tokens + 1e-6) // supply)) if supply else epochs
        extra = brute_prefix(leaves[leaf], tokens - whole * supply, whole, 4) if whole < epochs else []
        for r in leaves[leaf] * whole + extra:
            want[(leaf, r[0], r[1])] = want.get((leaf, r[0], r[1]), 0) + 1
    got = {}
    for r in mixed:
        k = ((r["_domain"], r["_lang"], r["_source"]), r["doc_id"], r["text"])
        got[k] = got.get(k, 0) + r["_copies"]
    assert got == want
    assert mixing.repeated(mixing.mix(docs, share=share, epochs=epochs, seed=4), ["doc_id"]).count() == sum(want.values())


def test_leaves_miss_their_budgets_by_half_a_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs, share=0.6, seed=3).collect()
    longest, got, budget = {}, {}, {}
    for r in docs.collect():
        leaf = (f"domain{int(r['source'][3:]) % 4}" if r["source"] else "other", r["lang"] or "?", r["source"] or "?")
        longest[leaf] = max(longest.get(leaf, 0), len(words(r["text"])))
    for r in rows:
        leaf = (r["_domain"], r["_lang"], r["_source"])
        got[leaf], budget[leaf] = got.get(leaf, 0) + r["_tokens"] * r["_copies"], r["_leaf_budget"]
    assert all(abs(got[leaf] - budget[leaf]) <= longest[leaf] / 2 + 1e-6 for leaf in got)
    assert abs(sum(got.values()) - sum(budget.values())) < 0.05 * sum(budget.values())


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0


def test_rows_keep_their_columns(spark):
    assert set(DOCS.replace(",", "").split()[::2]) <= set(mixing.mix(awkward(spark)).columns)
