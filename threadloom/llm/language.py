"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language come from one distributed aggregation and give a matrix of
log-probabilities, in blocks of columns of a fixed size, each of which is broadcast. A batch
of texts is scored as a sparse product: each n-gram occurrence adds its row of the matrix to
its text. With more languages than a block holds, the blocks are gone through one after the
other and a text carries its best language and its normaliser along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lean
from threadloom.llm.tokens import offsets_of

#: Buckets of hashed n-grams; the matrix has so many rows and a column for each language.
BUCKETS = 1 << 14
#: Labelled documents that a fit counts of each language, on average: a share of them, drawn by a hash of the id.
FIT_ROWS_PER_LANGUAGE = 4_000
#: Languages of a block of the matrix: 16 MB.
BLOCK = 256
#: Lengths of n-grams, in bytes of the lower-cased UTF-8 text.
ORDERS = (2, 3, 4)
UNKNOWN = "und"
#: Bytes of text whose n-grams are worked on at once, and cells of the matrix that are gathered at once.
_PIECE, _CELLS = 1 << 20, 1 << 24

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(9, 14), *range(33, 65), *range(91, 97), *range(123, 127)]] = 32  # ASCII digits and marks part words


Grams = Iterable[tuple[np.ndarray, np.ndarray]]
Model = list[tuple[list[str], np.ndarray]]


def _buckets(folded: np.ndarray, k: int) -> np.ndarray:
    """The bucket of the n-gram of k bytes that begins at each byte."""
    n = max(0, len(folded) - k + 1)
    h = np.full(n, 2166136261 + k, np.uint32)
    for j in range(k):
        h = (h ^ folded[j : j + n]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Grams:
    """(buckets, bounds by text) for each order. N-grams don't cross texts."""
    folded = _FOLD[data].astype(np.uint32)
    for k in ORDERS:
        bucket = _buckets(folded, k)
        n = len(bucket)
        keep = np.ones(n, bool)
        for j in range(1, k):  # those that begin in the last bytes of a text go
            at = offsets[1:] - j
            keep[at[(at >= 0) & (at < n)]] = False
        shorter = np.diff(offsets) < k
        for d in np.flatnonzero(shorter):
            keep[offsets[d] : min(offsets[d + 1], n)] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        yield bucket[keep], kept[np.minimum(offsets, n)]


def _long_grams(data: np.ndarray) -> Grams:
    """``_grams`` of one text of any length, in pieces that share as many bytes as no n-gram is lost by."""
    for k in ORDERS:
        for a in range(0, len(data) - k + 1, _PIECE):
            bucket = _buckets(_FOLD[data[a : a + _PIECE + k - 1]].astype(np.uint32), k)
            yield bucket, np.array([0, len(bucket)])


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, Grams]]:
    """(first row, rows, n-grams) of slices of about ``_PIECE`` bytes; a longer text is a slice of its own."""
    data, offsets = offsets_of(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _PIECE, "right")) - 1)
        own = data[offsets[row] : offsets[last]]
        yield row, last - row, _grams(own, offsets[row : last + 1] - offsets[row]) if len(own) <= _PIECE else _long_grams(own)
        row = last


def fit_languages(docs: DataFrame, rows_per_language: int = FIT_ROWS_PER_LANGUAGE) -> Model:
    """Blocks of languages, in the order of their names, with their (BUCKETS, languages) log-probabilities, add-one smoothed.

    ``docs`` has doc_id, text and lang; rows where text or lang is null are not learned from.
    Priors are equal. Without labelled rows the list is empty.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    # the share of each language that is counted comes from its number of rows: no window over a whole language
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row for each language
    return [_fit_block(known, sizes[a : a + BLOCK], rows_per_language) for a in range(0, len(sizes), BLOCK)]


def _fit_block(known: DataFrame, sizes: list, rows_per_language: int) -> tuple[list[str], np.ndarray]:
    langs = [r["lang"] for r in sizes]
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["n"]))])
    place = F.pmod(F.xxhash64(F.md5(F.col("doc_id").cast("string"))), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.filter(F.col("lang").isin(langs)).filter(F.coalesce(place, F.lit(0.0)) < F.element_at(share, F.col("lang"))).select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        total = np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, rows, grams in _pieces(batch.column(1)):
                own = lang[row : row + rows]
                for bucket, bounds in grams:
                    total += np.bincount(np.repeat(own, np.diff(bounds)) * BUCKETS + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counted = drawn.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows for a language at most
    counts = np.ones(len(langs) * BUCKETS)
    counts[counted["at"].to_numpy()] += counted["n"].to_numpy()
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)


def _add(total: np.ndarray, matrix: np.ndarray, bucket: np.ndarray, bounds: np.ndarray) -> None:
    """Adds the rows of ``matrix`` of each text's buckets to its row of ``total``, _CELLS at a time."""
    step = max(1, _CELLS // matrix.shape[1])
    for a in range(0, len(bucket), step):
        cut = np.clip(bounds, a, a + step) - a
        some = np.flatnonzero(np.diff(cut))
        total[some] += np.add.reduceat(matrix[bucket[a : a + step]], cut[some], axis=0, dtype=np.float64)


def _scored(docs: DataFrame, block: tuple[list[str], np.ndarray]) -> DataFrame:
    """row, text, letter, and of each text: its best language so far, that one's mean log-likelihood and the normaliser relative to it."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # BUCKETS x BLOCK floats at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        for batch in batches:
            best, top, norm = batch.column(3).to_pylist(), batch.column(4).to_numpy().copy(), batch.column(5).to_numpy().copy()
            for row, rows, pieces in _pieces(batch.column(1)):
                total, grams, own = np.zeros((rows, len(langs))), np.zeros(rows), slice(row, row + rows)
                for bucket, bounds in pieces:
                    _add(total, matrix, bucket, bounds)
                    grams += np.diff(bounds)
                mean = total / np.maximum(1, grams)[:, None] * np.minimum(50, np.maximum(1, grams))[:, None]
                here = mean.max(1)
                for d in np.flatnonzero(here > top[own]).tolist():
                    best[row + d] = langs[int(mean[d].argmax())]
                new = np.maximum(top[own], here)
                norm[own] = norm[own] * np.exp(top[own] - new) + np.exp(mean - new[:, None]).sum(1)
                top[own] = new
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best, pa.string()), pa.array(top), pa.array(norm)], names=batch.schema.names)

    return docs.mapInArrow(score, docs.schema)


def _identified(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score), where row is a struct of all columns of ``docs``."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    start = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), letter.alias("letter"), F.lit(UNKNOWN).alias("best"), F.lit(-np.inf).alias("top"), F.lit(0.0).alias("norm"))
    told = F.col("letter") & (F.col("best") != UNKNOWN)
    return reduce(_scored, model, start).select("row", F.when(told, F.col("best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(told, 1 / F.col("norm")).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score; ``keep`` must hold neither name.

    ``lang_pred`` is the likeliest language, or 'und' with score 0 where the text is null, has
    no letter or no language was learned; ties go to the first by name. ``score`` is its
    posterior under equal priors, with log-likelihoods taken by n-gram so that it doesn't
    saturate on long texts.
    """
    named = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    return _identified(named, model).select(*[F.col("row")[c].alias(c) for c in keep], "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit: crc32 of its id as text leaves 2 on division by 4; a null id is."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language was told; all columns stay as they are. The model is learned from ``docs`` itself."""
    lean(docs.sparkSession)
    model = fit_languages(docs)
    return _identified(docs, model).filter(F.col("lang_pred") != UNKNOWN).select("row.*")
