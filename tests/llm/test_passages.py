import hashlib
import random

from threadloom.llm import passages
from tests.llm.helpers import DOCS, awkward, awkward_rows, empty, order, prose, words


def brute(rows):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, order(r[0])), order(r[0]))
    out = []
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < order(r[0]):
                keep[i : i + 13] = [False] * 13
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((order(r[0]), len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((order(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_against_brute_force(spark):
    assert got(passages.remove_repeats(awkward(spark))) == brute(awkward_rows())


def test_many_small_shards_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(passages, "PER_SHARD", 8)
    rng = random.Random(5)
    common = [prose(rng, 14, 30) for _ in range(5)]
    rows = [(i, prose(rng, rng.randrange(20), 12) + " " + rng.choice(common) + "\t" + prose(rng, 5, 12) + "\n" + rng.choice(common), "en", "s", 0, 0, "", 0, "", "") for i in range(60)]
    rows.append((99, "loop " * 500, "en", "s", 0, 0, "", 0, "", ""))
    rows.append((100, "loop " * 50, "en", "s", 0, 0, "", 0, "", ""))
    assert got(passages.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4))) == brute(rows)


def test_a_short_line_everywhere(spark, monkeypatch):
    monkeypatch.setattr(passages, "PER_SHARD", 20)
    monkeypatch.setattr(passages, "WIDE", 20)
    dealt = []
    monkeypatch.setattr(passages, "_wide_windows", lambda *a, f=passages._wide_windows: dealt.append(1) or f(*a))
    rng = random.Random(6)
    line, more = prose(rng, 11, 9000), [prose(rng, 14, 9000) for _ in range(3)]
    rows = [(i, f"{prose(rng, 12, 9000)} {line}{' ' * (1 + i % 2)}{prose(rng, 12, 9000)} {rng.choice(more)}", "en", "s", 0, 0, "", 0, "", "") for i in range(80)]
    rows += [(200 + i, f"a{i % 3} {line} b{i % 2} c", "en", "s", 0, 0, "", 0, "", "") for i in range(40)]
    assert got(passages.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(4))) == brute(rows)
    assert dealt


def test_empty(spark):
    assert passages.remove_repeats(empty(spark)).count() == 0
