"""Toxic passages by maximum-scoring segments.

Words and their beginnings get log-odds between toxic and clean documents under an
informative Dirichlet prior (Monroe, Colaresi and Quinn 2008). A text is a sequence of
word scores, positive for significant units and a small constant below zero for the rest.
One linear scan (Ruzzo and Tompa 1999) finds all maximal scoring segments. How high a
segment must score to mean anything in a text of n words follows an extreme-value law
whose parameters come from clean documents (Karlin and Altschul 1990); a logistic
calibration turns the result into the probability of the label.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint, share
from threadloom.llm.tokens import CHUNK_BYTES, Words, mix, offsets_of, split_words

#: Labelled documents that a fit looks at, at most, the first in md5 order of the ids.
FIT_ROWS = 12_000
#: Units that the model selects, at most: those with the highest z-scores. A size of the model, not of what it scores.
MODEL_UNITS = 50_000
#: Units are whole words and their proper beginnings of these lengths in bytes.
BEGINNINGS = range(4, 13)
#: Documents that must hold a unit, and its least z-score.
MIN_DOCS, MIN_Z = 4, 3.5
#: Weight of the prior, as a share of the counts: each unit has so much of its own count as prior in both classes.
PRIOR = 0.05
#: Score of a word without a significant unit.
DRIFT = 0.25
#: Segments with a p-value up to this are significant.
SIGNIFICANT = 0.05

_APART = np.ones(256, bool)
_APART[65:91] = _APART[97:123] = _APART[128:] = False


def _plain(data: np.ndarray) -> np.ndarray:
    """Bytes with marks and digits as spaces, A-Z and the Latin-1 capitals of UTF-8 lowered."""
    out = np.where(_APART[data], np.uint8(32), data)
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def _texts(column: pa.Array) -> Iterator[tuple[int, Words]]:
    data, offsets = offsets_of(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES // 2, "right")) - 1)
        yield row, split_words(_plain(data[offsets[row] : offsets[last]]), offsets[row : last + 1] - offsets[row])
        row = last


def _units(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) for whole words and for each length of a beginning."""
    yield np.arange(len(words.begin)), words.hashes()
    size = words.end - words.begin
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        part = Words(words.data, words.begin[at], words.begin[at] + k, words.first)
        yield at, mix(part.hashes() ^ np.uint64(k))


@dataclass
class Lexicon:
    """Significant units, sorted by hash, with their log-odds."""

    hashes: np.ndarray
    odds: np.ndarray

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    def scores(self, words: Words) -> np.ndarray:
        """The score of each word: the highest of its units, or -DRIFT."""
        out = np.full(len(words.begin), -DRIFT)
        if not len(self.hashes):
            return out
        for at, h in _units(words):
            maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
            k = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            hit = self.hashes[k] == h[maybe]
            at, k = at[maybe[hit]], k[hit]
            out[at] = np.maximum(out[at], self.odds[k])
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (begin, end, score), in order. Words below zero are skipped in runs."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum after
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    for i, before, after in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        begin = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= after:
                found.append((begin, i + 1, before, after))
                break
            begin, before = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, r - l) for b, e, l, r in found]


@dataclass
class Model:
    lexicon: Lexicon
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # its K
    weights: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def expected(self, n_words: int, score: float) -> float:
        """Segments of at least this score that a clean text of so many words has on average."""
        return self.scale * max(1, n_words) * math.exp(-min(700.0, self.decay * score))

    def features(self, n_words: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        best = max((s for _, _, s in segments), default=0.0)
        significant = sum(s for _, _, s in segments if 1 - math.exp(-self.expected(n_words, s)) <= SIGNIFICANT)
        return max(-20.0, min(40.0, -math.log(self.expected(n_words, best)))), math.log1p(significant)

    def probability(self, n_words: int, segments: list[tuple[int, int, float]]) -> float:
        x, y = self.features(n_words, segments)
        z = self.weights[0] + self.weights[1] * x + self.weights[2] * y
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document are kept from the fit: crc32 of its id as text is a multiple of 5; so is a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a unit, by label."""
    for batch in batches:
        toxic = batch.column(0).to_numpy().astype(bool)
        for row, words in _texts(batch.column(1)):
            doc = words.doc_of_word()
            for label in (False, True):
                own = toxic[row + doc] == label
                hashes, docs = [], []
                for at, h in _units(words):
                    keep = own[at]
                    hashes.append(h[keep])
                    docs.append(doc[at[keep]])
                h, d = np.concatenate(hashes), np.concatenate(docs).astype(np.uint64)
                pairs = np.unique(np.stack([h, d]), axis=1)[0] if len(h) < 1000 else _first_of_pairs(h, d)
                u, n = np.unique(pairs, return_counts=True)
                zero = np.zeros(len(u), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n if label else zero), pa.array(zero if label else n)], names=["unit", "toxic", "clean"])


def _first_of_pairs(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new]


def _hits(lexicon: Broadcast[bytes]):
    """From (toxic, text) of clean documents: how often each value of a significant word occurs; value -DRIFT counts the other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(lexicon.value)
        for batch in batches:
            for _, words in _texts(batch.column(1)):
                value, n = np.unique(known.scores(words), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["value", "n"])

    return run


def _best(model: Broadcast[bytes]):
    """A row for each labelled text: label, words, the score of its best segment and, under the law of the model, its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model.value)
        for batch in batches:
            rows = []
            for row, words in _texts(batch.column(1)):
                scores = known.lexicon.scores(words)
                for d in range(len(words.first) - 1):
                    own = scores[words.first[d] : words.first[d + 1]]
                    found = maximal_segments(own)
                    rows.append((batch.column(0)[row + d].as_py(), len(own), max((s for _, _, s in found), default=0.0), *known.features(len(own), found)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["toxic", "n", "best", "x", "y"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights (constant first) by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents; rows with null or contradicting labels are left out.

    At most ``fit_rows`` labelled documents are looked at. The driver gets the units of the model,
    the counts of their values and, for each of these documents, five numbers. With one class only,
    the model has no unit and scores all texts low.
    """
    spark = docs.sparkSession
    chosen = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .filter("toxic = other")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(fit_rows)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    )
    # fit_rows rows at most; written, as are the counts, because they are read more than once
    known = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    counts = checkpoint(known.mapInArrow(_count, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = totals["t"] or 0, totals["c"] or 0
    if not t or not c:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    y, n = F.col("toxic") + prior, F.col("clean") + prior
    total = PRIOR * float(t + c)
    odds = F.log(y / (t + total - y)) - F.log(n / (c + total - n))
    scored = counts.filter(F.col("toxic") >= MIN_DOCS).select("unit", odds.alias("odds"), (odds / F.sqrt(1 / y + 1 / n)).alias("z"))
    best = scored.filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "unit").limit(MODEL_UNITS).collect()
    found = sorted((r["unit"] & 0xFFFFFFFFFFFFFFFF, r["odds"]) for r in best)
    lexicon = Lexicon(np.array([h for h, _ in found], np.uint64), np.array([o for _, o in found], float))
    return calibrate(known, lexicon)


def calibrate(known: DataFrame, lexicon: Lexicon) -> Model:
    """The extreme-value law from the clean rows of ``known`` (toxic, text), then the logistic weights from all."""
    spark = known.sparkSession
    clean = known.filter("toxic = 0").mapInArrow(_hits(share(spark, lexicon)), "value double, n long")
    counted = clean.groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").collect()  # a row for each value of a unit
    value, times = np.array([r["value"] for r in counted], float), np.array([r["n"] for r in counted], float)

    def excess(x: float) -> float:
        return float((times * np.exp(x * value)).sum()) / max(1.0, times.sum()) - 1

    lo, hi = 1e-6, 1e-6
    while hi < 50 and excess(hi) < 0:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model = Model(lexicon, max(0.05, min(5.0, lo)))

    def profile(model: Model) -> list:
        rows = known.mapInArrow(_best(share(spark, model)), "toxic int, n long, best double, x double, y double").collect()
        return sorted(rows, key=tuple)  # five numbers for each of the fit's documents

    seen = [r for r in profile(model) if not r["toxic"]]
    model.scale = max(1, len(seen)) / max(1e-9, sum(max(1, r["n"]) * math.exp(-model.decay * r["best"]) for r in seen))
    rows = profile(model)
    model.weights = _logistic(np.array([(r["x"], r["y"]) for r in rows]).reshape(-1, 2), np.array([float(r["toxic"]) for r in rows]))
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and segments (begin, end, score, p_value) of every row.

    ``score`` is the probability of the label, from the text alone; ``segments`` are the significant
    passages, as ranges of words (runs of letters). A null, empty or wordless text has no segment
    and the score of a text without findings. Repeated rows each get a row; extra columns are ignored.
    """
    shared = share(docs.sparkSession, model)  # MODEL_UNITS units at most
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(shared.value)
        for batch in batches:
            score, segments = [], []
            for _, words in _texts(batch.column(1)):
                all_scores = known.lexicon.scores(words)
                for d in range(len(words.first) - 1):
                    own = all_scores[words.first[d] : words.first[d + 1]]
                    found = maximal_segments(own)
                    score.append(known.probability(len(own), found))
                    tested = [{"begin": b, "end": e, "score": s, "p_value": 1 - math.exp(-known.expected(len(own), s))} for b, e, s in found]
                    segments.append([x for x in tested if x["p_value"] <= SIGNIFICANT])
            predicted = [int(s >= 0.5) for s in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(predicted, pa.int32()), pa.array(segments, pa.list_(span))], names=["doc_id", "score", "predicted", "segments"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, segments array<struct<begin:long,end:long,score:double,p_value:double>>")
