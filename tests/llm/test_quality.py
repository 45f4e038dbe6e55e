import re

from pyspark.sql import functions as F

from threadloom.llm import quality
from tests.llm.helpers import awkward, empty, words


def brute(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 2000 else False:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    extra = [(900, "a b a b a b c"), (901, "l1 x\nl1 x\n\n\nl1 x\r\nz #*$%&|<> é𝄞"), (902, "a a a"), (903, "a a a a"), (904, "k " * 60 + "m n o p " * 2)]
    docs = awkward(spark).select("doc_id", "text", "n_words").filter("length(text) < 20000 OR text IS NULL").unionByName(spark.createDataFrame([(*e, 1) for e in extra], "doc_id long, text string, n_words int"))
    for r in quality.text_statistics(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(r["text"]), r["text"]


def test_decision_list_finds_planted_rules():
    rows = [({"n_words": float(50 + i), "symbol_share": (i % 10) / 100, "mean_word": 5.0 + (i % 7), "dup_line_share": 0.0, "repeat_share": 0.0}, False) for i in range(300)]
    rows += [({"n_words": float(60 + i), "symbol_share": 0.3 + i / 1000, "mean_word": 6.0, "dup_line_share": 0.0, "repeat_share": 0.0}, True) for i in range(40)]
    rows += [({"n_words": float(60 + i), "symbol_share": 0.02, "mean_word": 25.0, "dup_line_share": 0.0, "repeat_share": 0.0}, True) for i in range(40)]
    rules = quality.learn_decision_list(rows)
    assert 1 <= len(rules) <= 4
    assert all(any(quality._holds(x, r) for r in rules) == y for x, y in rows)


def test_no_labels_no_rules(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_rules(awkward(spark), labels) == []
    judged = quality.judge_quality(awkward(spark), [])
    assert judged.filter(F.col("kept") == F.col("base_failed")).count() == 0
    assert judged.count() == awkward(spark).count()
    assert quality.judge_quality(empty(spark), []).count() == 0


def test_rules_become_one_expression(spark):
    rules = [[("symbol_share", ">", 0.2), ("n_words", "<=", 100.0)], [("mean_word", ">", 9.0)]]
    docs = spark.createDataFrame([(1, "# # # " * 20), (2, "abcdefghijkl " * 3 + " ".join(f"verylongword{i}" for i in range(60))), (3, " ".join(f"w{i}" for i in range(80)))], "doc_id long, text string")
    got = {r["doc_id"]: (r["rule"], r["kept"]) for r in quality.judge_quality(docs, rules).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (0, True)}
