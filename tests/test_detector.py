"""The detector on messages whose scores were worked out by hand."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import detector as D
from threadloom.functions.text import strip

#: text, score, level, anti score
MESSAGES = [
    ("决定", 0.45, "low", 0.0),  # one word of weight 1
    ("决定使用 Redis", 0.765, "high", 0.0),  # 0.45 + 0.35 * 0.8, halfway to the pattern's 0.8
    ("LGTM", 0.315, "low", 0.0),  # 0.45 * 0.7
    ("hello", 0.0, "none", 0.3),
    ("maybe use Redis", 0.0, "none", 0.4),
    ("我反对", 0.54, "medium", 0.0),  # a pattern of 0.8 alone
    ("todo: fix bug, owner Ann", 0.36, "low", 0.0),  # three words, 0.65, and an assignment, 0.45
    ("投票结果", 0.4725, "low", 0.0),
    ("进度 更新一下", 0.0, "none", 0.5),
    ("谢谢，可能", 0.0, "none", 0.7),  # stopped
    ("方案A vs 方案B 对比", 0.3, "low", 0.0),
    ("由小王来负责", 0.485, "low", 0.0),  # two patterns, the higher 0.55
    ("谢谢 决定使用 Redis", 0.65025, "high", 0.3),  # 0.765 less 15 %
    ("nothing here", 0.0, "none", 0.0),
]


def test_messages(spark):
    df = spark.createDataFrame([(m[0],) for m in MESSAGES], "text string").coalesce(1)
    got = [r["d"] for r in df.select(D.detect_message(F.col("text")).alias("d")).collect()]
    for (text, score, level, anti), d in zip(MESSAGES, got, strict=True):
        assert (d["score"], d["level"], d["is_decision"], d["anti_score"]) == (pytest.approx(score, abs=1e-9), level, level in ("high", "medium"), pytest.approx(anti)), text


def test_context(spark):
    df = spark.createDataFrame([("redis cache", True, True, 3, ["Redis", "cache"])], "text string, reply boolean, mention boolean, i int, recent array<string>")
    d = df.select(D.detect_message(F.col("text"), F.col("reply"), F.col("mention"), F.col("i"), F.col("recent")).alias("d")).first()["d"]
    assert d["score"] == pytest.approx(0.025) and d["level"] == "none"  # 0.05 * (0.4 + 0.1)


def test_documents(spark):
    rows = [("# 技术选型\n采用 Redis", "design", 0.575, "high"), ("# 技术选型\n采用 Redis", "weekly_report", 0.0, "none"), ("fix typo", "unknown", 0.0, "none"), ("结论就是使用工具 TODO", "unknown", 0.636, "high")]
    df = spark.createDataFrame([r[:2] for r in rows], "text string, kind string").coalesce(1)
    got = [r["d"] for r in df.select(D.detect_document(F.col("text"), F.col("kind")).alias("d")).collect()]
    # the last: words 结论 0.9, 使用 and todo make 1.0; patterns 结论就 and 使用工具 0.75; open points take 4 %
    assert [(round(d["score"], 4), d["level"]) for d in got] == [(s, lv) for *_, s, lv in rows[:3]] + [(round((0.4 * 1.0 + 0.35 * 0.75) * 0.96, 4), "high")]


def _odd_texts(n):
    """Texts of pieces of the patterns, with what may stand between them."""
    rng, texts = random.Random(5), []
    pieces = [re.findall(r"[一-鿿]+|[A-Za-z]+", p) for p, _ in D.PATTERNS + D.DOC_PATTERNS]
    words = [w for ws, _ in D.LEXICAL + D.AGAINST for w in ws] + D.TECHNICAL + D.OPTIONS + ["「", "É", "ß ", "İ", "😀"]
    for k in range(n):
        own = pieces[k % len(pieces)]
        texts.append("".join(rng.choice(own if rng.random() < 0.7 else words) + rng.choice(["", "", "", " ", "，", "# ", "：x", "是", "就", "3月", "\n", "A"]) for _ in range(rng.randint(1, 5))))
    return texts + ["", " ", "Pros", "option A", "Option  B", "ddl 3/", "#  决定", "我觉得们用", "请 @小王来 跟进"]


def test_patterns_and_words_are_found_where_they_are(spark):
    df = spark.createDataFrame([(t,) for t in _odd_texts(2000)], "text string").repartition(4)
    tables, lists = [(D.PATTERNS, D.PATTERN_WORDS), (D.DOC_PATTERNS, D.DOC_PATTERN_WORDS)], [ws for ws, _ in D.LEXICAL + D.AGAINST] + [D.LISTS, D.OPTIONS, D.TECHNICAL, D.ASSIGNMENTS, D.DOC_SIGNALS, D.MINOR_EDITS, D.OPEN_POINTS]
    low, broad = F.lower("text"), D.wide(F.lower("text"))
    plain = F.array(*[F.col("text").rlike(p) for table, _ in tables for p, _ in table])
    gated = F.array(*[D._finds(F.col("text"), broad, ws) & F.col("text").rlike(p) for table, words in tables for (p, _), ws in zip(table, words, strict=True)])
    rows = df.select("text", low.alias("low"), plain.alias("plain"), gated.alias("gated"), F.array(*[D._holds(low, broad, ws) for ws in lists]).alias("held")).collect()
    assert all(r["plain"] == r["gated"] for r in rows) and all(map(any, zip(*[r["plain"] for r in rows], strict=True)))
    assert all(r["held"] == [any(w.lower() in r["low"] for w in ws) for ws in lists] for r in rows)


def test_patterns_are_tried_only_where_one_of_their_words_is(spark):
    df = spark.createDataFrame([("决定使用 Redis 结论是", "决定使用 结论是"), ("决定使用 Redis 结论是", " ")], "text string, broad string").coalesce(1)
    got = [[r["a"], r["b"]] for r in df.select(D.patterns(F.col("text"), F.col("broad")).alias("a"), D.patterns(F.col("text"), F.col("broad"), D.DOC_PATTERNS, D.DOC_PATTERN_WORDS).alias("b")).collect()]
    assert got[0] == [pytest.approx(0.8), pytest.approx(0.9)] and got[1] == [0.0, 0.0]
    assert df.select(D.wide(F.lit("all of it is ÀÉß, 决定 and 1.")).alias("w")).first()["w"] == " 决定 "


def test_blanks_within_a_text_are_passed_once(spark):
    df = spark.createDataFrame([("\t\n a" + " " * 400_000 + "b \r\x0b\f",)], "text string").coalesce(1)
    began = time.time()
    assert df.select(F.length(strip(F.col("text"))).alias("n")).first()["n"] == 400_002
    assert time.time() - began < 15  # a pattern for white space at the end began anew at each of the blanks
