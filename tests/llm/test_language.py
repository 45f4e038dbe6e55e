import math
import random

from pyspark.sql import functions as F

from threadloom.llm import language
from tests.llm.helpers import awkward, empty

PIECES = {"aa": ["the", "ing", "and", "tion"], "bb": ["éa", "oux", "leau", "que"], "cc": ["sch", "ung", "keit", "ö"]}


def corpus(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices(PIECES[lang], k=3)) for _ in range(rng.randrange(5, 80))), lang) for i, lang in enumerate(rng.choices(sorted(PIECES), k=400))]
    rows += [(1000, "no label", None), (1001, None, "aa")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark):
    docs, truth = corpus(spark)
    model = language.fit_languages(docs.filter(~language.held_out(F.col("doc_id"))))
    assert model[0][0] == ["aa", "bb", "cc"]
    found = language.identify(docs, model, ["doc_id"]).filter("doc_id < 1000").collect()
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) / len(found) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_texts_without_letters(spark):
    docs, _ = corpus(spark)
    model = language.fit_languages(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 #!"), (4, "é"), (5, "a"), (6, "中文"), (7, "\n \t")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model, ["doc_id"]).collect()}
    assert [k for k, v in found.items() if v == "und"] and {k for k, v in found.items() if v == "und"} == {1, 2, 3, 7}
    kept = language.identify(awkward(spark), model, awkward(spark).columns)
    assert kept.count() == awkward(spark).count()


def bucket(gram):
    h = (2166136261 + len(gram)) & 0xFFFFFFFF
    for c in gram:
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    h ^= h >> 15
    return ((h * 2654435761) & 0xFFFFFFFF) >> 18


def grams(text):
    plain = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 or 33 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 else c for c in text.encode())
    return [bucket(plain[i : i + k]) for k in (2, 3, 4) for i in range(len(plain) - k + 1)]


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 2)  # two languages, then the third
    monkeypatch.setattr(language, "_CELLS", 64)
    docs, truth = corpus(spark)
    rows = [tuple(r) for r in docs.collect()]
    counts = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            for g in grams(text):
                own = counts.setdefault(lang, {})
                own[g] = own.get(g, 0) + 1
    totals = {x: sum(c.values()) + language.BUCKETS for x, c in counts.items()}
    model = language.fit_languages(docs)
    assert [len(langs) for langs, _ in model] == [2, 1]
    for r in language.identify(docs, model, ["doc_id", "text"]).collect():
        if r["text"] is None:
            continue
        g = grams(r["text"])
        mean = {x: sum(math.log((c.get(b, 0) + 1) / totals[x]) for b in g) / max(1, len(g)) * min(50, max(1, len(g))) for x, c in counts.items()}
        best = max(sorted(mean), key=mean.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(math.exp(v - mean[best]) for v in mean.values())) < 1e-4


def test_nothing_to_learn(spark):
    model = language.fit_languages(empty(spark))
    assert {r["lang_pred"] for r in language.identify(awkward(spark), model, ["doc_id"]).collect()} == {"und"}
    assert language.identify(empty(spark), model, ["doc_id"]).count() == 0


def test_a_chunk_scores_as_its_parts(spark, monkeypatch):
    docs, _ = corpus(spark)
    model = language.fit_languages(docs)
    whole = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.identify(docs.coalesce(1), model, ["doc_id"]).collect()}
    monkeypatch.setattr(language, "_PIECE", 50)
    parts = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.identify(docs.coalesce(1), model, ["doc_id"]).collect()}
    assert whole == parts
