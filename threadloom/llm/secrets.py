"""Secret scan: candidate strings, judged by a random forest.

A broad pattern finds candidates: runs of the characters that keys are made of, of eight or
more with a digit, or of sixteen or more. Most aren't secrets, so a random forest that looks at
their length, character transitions, dictionary coverage, path and neighbouring words removes
the false positives. It is trained from labelled findings: a table of reviewed ones if there is
one, else ``planted_findings``, whose labels are known because the strings were made as secrets
or as something else, whatever the features say of them.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint
from threadloom.llm.tokens import offsets_of

_BODY = r"A-Za-z0-9+/_\-.~!@#$%^&*:"
#: Candidates: a letter or digit and what follows of the characters of keys, mail addresses and paths, up to the last letter or digit.
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9])(?=[{_BODY}]{{0,255}}[0-9]|[A-Za-z0-9+/_\-]{{16}})[A-Za-z0-9][{_BODY}]{{6,}}[A-Za-z0-9]={{0,2}}")
#: Labelled findings that a fit takes of each class, at most, the first in md5 order of place and text.
FIT_FINDINGS = 5_000
#: Planted findings of each class.
PLANTED = 1_500
FEATURES = ["length", "entropy", "digit_share", "upper_share", "hex_share", "transitions", "longest_letters", "dictionary", "path_marks", "in_path", "assigned", "quoted", "keyword_before", "placeholder_near", "joined_after"]

#: Words that name a credential.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "credential", "auth", "bearer", "private")
#: Words around samples that aren't real.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "test", "xxxx")
#: Beginnings that public providers give to their keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "eyJ")
_KEYWORD = re.compile("|".join(KEYWORDS), re.I)
_PLACEHOLDER = re.compile("|".join(PLACEHOLDERS), re.I)
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_LETTERS = re.compile(r"[A-Za-z]+")


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(candidate: str, before: str, after: str, common: frozenset[str] = frozenset()) -> list[float]:
    """The values of FEATURES for a candidate between two stretches of text. ``common`` has frequent 3-letter runs of words."""
    n = len(candidate)
    kinds = [_kind(c) for c in candidate]
    counts: dict[str, int] = {}
    for c in candidate:
        counts[c] = counts.get(c, 0) + 1
    runs = [r.lower() for r in _LETTERS.findall(candidate)]
    grams = [r[i : i + 3] for r in runs for i in range(len(r) - 2)]
    words_before = before[-32:]
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        kinds.count(2) / n,
        kinds.count(1) / n,
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        max((len(r) for r in runs), default=0) / n,
        sum(g in common for g in grams) / max(1, n - 2),
        candidate.count("/") / n,
        float(before[-1:] in "/." or bool(re.search(r"://\S*$", before))) if before else 0.0,
        float(bool(_ASSIGNED.search(before))),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`") if before and after else 0.0,
        float(bool(_KEYWORD.search(words_before))),
        float(bool(_PLACEHOLDER.search(before[-24:] + candidate + after[:24]))),
        float(after[:1] in "@/.:") if after else 0.0,
    ]


def common_letters(docs: DataFrame, most: int = 4_096) -> frozenset[str]:
    """The dictionary: the ``most`` commonest runs of three ASCII letters over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 15, np.int64)
        for batch in batches:
            data, offsets = offsets_of(batch.column(0))
            for a in range(int(offsets[0]), int(offsets[-1]), 1 << 21):
                part = data[a : min(a + (1 << 21), int(offsets[-1]))]
                low = part | 32
                code = np.where((low >= 97) & (low <= 122), low.astype(np.int32) - 96, 0)
                if len(code) > 2:
                    x, y, z = code[:-2], code[1:-1], code[2:]
                    all_letters = (x > 0) & (y > 0) & (z > 0)
                    total += np.bincount(((x << 10) | (y << 5) | z)[all_letters], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "gram").limit(most).collect()  # 32,768 rows at most
    letter = lambda k: chr(96 + (k & 31))
    return frozenset(letter(r["gram"] >> 10) + letter(r["gram"] >> 5) + letter(r["gram"]) for r in rows)


def find_candidates(docs: DataFrame, common: frozenset[str] = frozenset(), context: int = 48) -> DataFrame:
    """doc_id, begin (code points), length, digest, prefixed and the FEATURES of every candidate of every text.

    The candidate itself isn't returned, only the first 16 hex digits of its SHA-256. A null or
    empty text has none; repeated rows repeat their findings.
    """
    schema = "doc_id long, begin long, length long, digest string, prefixed boolean, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for m in CANDIDATE.finditer(text):
                    c, before, after = m[0], text[max(0, m.start() - context) : m.start()], text[m.end() : m.end() + context]
                    digest = hashlib.sha256(c.encode()).hexdigest()[:16]
                    rows.append((doc_id, m.start(), len(c), digest, c.startswith(PREFIXES), features(c, before, after, common)))
                if len(rows) > 20_000:
                    yield _table(rows)
                    rows = []
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.float64())]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "begin", "length", "digest", "prefixed", "features"])

    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    return found.select("doc_id", "begin", "length", "digest", "prefixed", *[F.col("features")[i].alias(f"f_{k}") for i, k in enumerate(FEATURES)])


def _secret(rng: random.Random) -> tuple[str, str]:
    """A made-up secret, and how the text before it ends."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    hexes, base, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    kind = rng.randrange(6)
    if kind == 0:  # providers' keys give themselves away, wherever they stand
        return rng.choice(["AKIA", "ASIA"]) + pick(upper, 16), rng.choice(["", "key ", 'id="', "export KEY=", "(", "use "])
    if kind == 1:
        return rng.choice(["ghp_", "gho_", "sk_live_", "glpat-", "xoxb-"]) + pick(base, rng.choice([20, 24, 36])), rng.choice(["", "token: ", 'header "', "login with "])
    name = rng.choice([*KEYWORDS, *(k.upper() for k in KEYWORDS)])
    before = name + rng.choice(["=", " = ", ": ", ":", '="', ' = "', " = '", '": "'])
    if kind == 2:
        return pick(hexes, rng.choice([16, 18, 24, 32, 40, 64])), before
    if kind == 3:
        return pick(base, rng.randrange(10, 48)) + str(rng.randrange(10)), before
    if kind == 4:
        return base64.b64encode(rng.randbytes(rng.randrange(12, 40))).decode(), before
    return pick(base[:52], rng.randrange(3, 8)) + rng.choice("!@#$%&*") + pick(base, rng.randrange(3, 8)) + str(rng.randrange(100)), before


def _harmless(rng: random.Random) -> tuple[str, str]:
    """Something that isn't a secret though it has digits or is long, and how the text before it ends."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    word = lambda: "".join(rng.choices(["an", "er", "the", "tion", "ing", "sch", "en", "os", "ment"], k=rng.randrange(1, 5)))
    number = lambda n: pick("0123456789", n)
    kind, before = rng.randrange(12), rng.choice(["", "", word() + " ", word() + ": ", "see ", "(", "= "])
    made = [
        lambda: (pick("0123456789abcdef", rng.choice([16, 32, 40, 64])), rng.choice(["commit ", "sha256 ", "md5: ", "digest ", "revision ", "checksum = ", ""])),
        lambda: (str(uuid.UUID(int=rng.getrandbits(128))), rng.choice(["id ", "request ", "id=", "run: "])),
        lambda: (word() + "." + word() + number(3) + "@" + word() + "." + rng.choice(["org", "com", "net"]), before),
        lambda: (".".join(str(rng.randrange(256)) for _ in range(4)), before),
        lambda: (f"20{number(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" + rng.choice(["", "T10:20:30"]), before),
        lambda: ("-".join(number(n) for n in (3, 3, 4)), rng.choice([before, "call ", "phone: "])),
        lambda: ("/".join(word() for _ in range(rng.randrange(2, 6))) + "/" + word() + number(2) + ".py", rng.choice([before, "path=", "file: "])),
        lambda: ("https://" + word() + ".com/" + word() + "/" + number(4), before),
        lambda: ("".join(word() for _ in range(8)), before),
        lambda: (number(rng.randrange(8, 20)), rng.choice([before, "order ", "account ", "isbn: "])),
        lambda: (word() + "_" + word() + number(2) + "_" + word() + word(), before),
        lambda: (rng.choice(PLACEHOLDERS) + "-" + pick("0123456789abcdef", 12), rng.choice([*KEYWORDS]) + rng.choice(["=", ": "])),
    ]
    return made[kind]()


def planted_findings(spark: SparkSession, common: frozenset[str] = frozenset(), each: int = PLANTED, seed: int = 11) -> DataFrame:
    """Labelled findings: ``each`` made-up secrets and as many harmless strings, planted in made-up prose, as ``find_candidates`` sees them.

    A label says what a string was made as; the features are only taken afterwards, from the texts.
    """
    rng, rows = random.Random(seed), []
    prose = lambda: " ".join("".join(rng.choices(["an", "er", "the", "ti", "on", "ing", "sch", "en", "o", "la", "de"], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 9)))
    for i in range(2 * each):
        made, before = _secret(rng) if i % 2 else _harmless(rng)
        start = prose() + rng.choice([" ", ". ", "\n"]) + before
        after = before[-1:] if before[-1:] in "\"'" else rng.choice(["", ".", ",", "\n"])
        rows.append((i, start + made + after + " " + prose(), len(start), float(i % 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string, at long, label double")  # 2 * each rows
    found = find_candidates(df.select("doc_id", "text"), common)
    return found.join(df.select("doc_id", "at", "label"), "doc_id").filter("begin = at").drop("at")


def fit_forest(labelled: DataFrame, findings: int = FIT_FINDINGS, trees: int = 30, depth: int = 6, seed: int = 5) -> PipelineModel | None:
    """A random forest from labelled findings (label 0 or 1 and the FEATURES); None if one class is missing.

    It takes at most ``findings`` of each class.
    """
    place = F.md5(F.concat_ws(":", "digest", F.col("doc_id").cast("string"), F.col("begin").cast("string")))
    by_class = [labelled.filter(F.col("label") == y).orderBy(place, "doc_id", "begin").limit(findings) for y in (0.0, 1.0)]
    if not all(d.limit(1).count() for d in by_class):
        return None
    few = checkpoint(by_class[0].union(by_class[1]))  # read once for each level of the trees
    forest = RandomForestClassifier(labelCol="label", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="vector"), forest]).fit(few)


def judge(candidates: DataFrame, forest: PipelineModel | None) -> DataFrame:
    """doc_id, begin, length, digest, score and is_secret. Without a forest only provider prefixes count."""
    plain = ["doc_id", "begin", "length", "digest"]
    if forest is None:
        return candidates.select(*plain, F.col("prefixed").cast("double").alias("score"), F.col("prefixed").alias("is_secret"))
    scored = forest.transform(candidates).select(*plain, vector_to_array("probability")[1].alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The secrets of every document: doc_id, begin, length, digest and score.

    ``labelled`` has findings of ``find_candidates`` with a label, as reviewed by someone; by default
    it is ``planted_findings``. Null ids and extra columns are allowed; an empty table gives none.
    """
    common = common_letters(docs)
    labelled = planted_findings(docs.sparkSession, common) if labelled is None else labelled
    return judge(find_candidates(docs, common), fit_forest(labelled)).filter("is_secret").drop("is_secret")
