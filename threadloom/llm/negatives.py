"""Hard negatives by distributed radix selection.

To find the k best rows in a window of scores, for many windows at once, tasks count rows by
the leading digit of their score's distance from the window's top; the sums show in which
digit the kth row lies, and the next round counts only within it, by the next digit. Where
more rows than wanted tie at the kth score, rounds go on by the digits of their ids. Then one
pass gathers the rows that qualify, k for each window. A task reports a window's counts only
up to the digit where it has seen k rows itself, since the kth row of all lies no farther.

Anchors are a stated set of queries. They go out in blocks of a fixed number, each scored
against all rows in tasks as a matrix product; nothing is joined.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import shared_folder
from threadloom.llm.vectors import integer_vectors, matrix, one_length

#: Anchors of a block.
BLOCK = 2048
#: Bits of a digit.
DIGIT = 9
#: Cells of scores that a task works on at once.
_CELLS = 1 << 21
_ALL = np.iinfo(np.int64).max


@dataclass
class Windows:
    """Windows of scores, ``per`` for each anchor of a block: window w is one of anchor w // per.

    A row is in a window if its score lies between ``low`` and ``high`` and its label is the
    anchor's own (``own``) or another. ``score`` and ``id`` are the bounds found: rows of a
    higher score qualify, and those of this score up to that id.
    """

    anchors: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    per: int
    own: bool
    low: np.ndarray
    high: np.ndarray
    score: np.ndarray
    id: np.ndarray

    def cells(self, v: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores of every anchor and row, whether the row's label admits it)."""
        s = (self.anchors @ v.T).astype(np.int64)
        same = self.labels[:, None] == labels[None, :]
        return s, same & (self.ids[:, None] != ids[None, :]) if self.own else ~same


def _batches(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, label numbers, vectors) of runs of rows whose scores fill at most _CELLS cells."""
    step = max(1, _CELLS // max(1, anchors))
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a in range(0, len(ids), step):
            yield ids[a : a + step], labels[a : a + step], matrix(batch.column(2).slice(a, step)).astype(np.float64)


def _end(begin: np.ndarray, digits: np.ndarray | int, shift: int) -> np.ndarray:
    """The last key of so many digits from ``begin`` on, held to 64 bits."""
    digits = np.broadcast_to(digits, len(begin)).tolist()
    return np.array([min(b + (d << shift) - 1, _ALL) for b, d in zip(begin.tolist(), digits, strict=True)], np.int64)


def _digits(rows: DataFrame, w: Windows, by_id: bool, begin: np.ndarray, shift: int, need: np.ndarray) -> list:
    """(window, digit, rows before it, rows in it) of the digit that holds the ``need``-th row, or of no digit (-1) where fewer are left.

    Keys are distances from the window's top score, or, among rows of the bound score, ids;
    only keys from ``begin`` to begin + (1 << shift + DIGIT) - 1 count. A row for each open window comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast((w, begin, need))
    bins = 1 << DIGIT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, begin, need = shared.value
        n, per = len(need), w.per
        counts = np.zeros((n, bins), np.int64)
        reach = np.where(need > 0, _end(begin, bins, shift), 0)  # the farthest key that still matters to this task
        for ids, labels, v in _batches(batches, len(w.ids)):
            s, admitted = w.cells(v, labels, ids)
            seen = False
            for p in range(per):
                own = slice(p, n, per)
                live = need[own, None] > 0
                if not live.any():
                    continue
                if by_id:
                    i = ids[None, :]
                    hit = admitted & live & (s == w.score[own, None]) & (i >= begin[own, None]) & (i <= reach[own, None])
                    a, r = np.nonzero(hit)
                    key = ids[r]
                else:
                    top = w.high[own, None]
                    hit = admitted & live & (s <= top - begin[own, None]) & (s >= np.maximum(w.low[own, None], top - reach[own, None]))
                    a, r = np.nonzero(hit)
                    key = w.high[own][a] - s[a, r]
                if len(a):
                    at = a * per + p
                    gap = key.view(np.uint64) - begin[at].view(np.uint64)  # ids may lie farther apart than a long holds
                    np.add.at(counts, (at, (gap >> np.uint64(shift)).astype(np.int64)), 1)
                    seen = True
            if seen:
                full = counts.cumsum(1) >= need[:, None]
                far = np.where(full.any(1), full.argmax(1), bins - 1)
                reach = np.where(need > 0, _end(begin, far + 1, shift), 0)
        full = counts.cumsum(1) - counts >= need[:, None]  # the need-th row comes before
        at, d = np.nonzero((counts > 0) & ~full)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(counts[at, d])], ["w", "digit", "n"])

    summed = rows.mapInArrow(count, "w int, digit int, n long").groupBy("w", "digit").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("w").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wanted = rows.sparkSession.createDataFrame([(int(k), int(need[k])) for k in np.flatnonzero(need > 0)], "w int, need long")
    found = summed.withColumn("upto", upto).join(F.broadcast(wanted), "w")  # a row for each window of a block
    return found.filter("upto >= need").groupBy("w").agg(F.min(F.struct("digit", (F.col("upto") - F.col("n")).alias("before"), "n")).alias("x")).select("w", "x.*").collect()


def _narrowed(rows: DataFrame, w: Windows, by_id: bool, begin: np.ndarray, width: int, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window with ``need`` above 0: (the last key that qualifies, or _ALL where all do; rows still wanted at that key; whether too many have it)."""
    last, rest, tied = np.full(len(need), _ALL), np.zeros(len(need), np.int64), np.zeros(len(need), bool)
    shift = max(0, (max(0, width).bit_length() + DIGIT - 1) // DIGIT * DIGIT - DIGIT)
    begin, need = begin.copy(), need.copy()
    while (need > 0).any():
        met = np.zeros(len(need), bool)
        for k, digit, before, n in _digits(rows, w, by_id, begin, shift, need):
            met[k] = True
            begin[k] = int(begin[k]) + (digit << shift)
            need[k] -= before
            if n == need[k] or shift == 0:
                last[k], rest[k], tied[k] = min(int(begin[k]) + (1 << shift) - 1, _ALL), need[k], n > need[k]
                need[k] = 0
        need[~met] = 0  # fewer rows than wanted: all of them qualify
        shift -= DIGIT
    return last, rest, tied


def select(rows: DataFrame, w: Windows, k: int, ids: tuple[int, int]) -> DataFrame:
    """(w, rank, id, score) of the first k rows of each window, by descending score, then id; ``ids`` are the least and largest id."""
    open_ = np.where(w.low <= w.high, k, 0)
    width = int((w.high - w.low).max(initial=0))
    key, rest, tied = _narrowed(rows, w, False, np.zeros(len(open_), np.int64), width, open_)
    low = np.where(key == _ALL, w.low, np.maximum(w.low, w.high - np.minimum(key, w.high - w.low)))
    w = replace(w, score=np.where(open_ > 0, low, _ALL), id=np.full(len(open_), _ALL))
    if tied.any():
        last, _, _ = _narrowed(rows, w, True, np.full(len(open_), ids[0]), ids[1] - ids[0], np.where(tied, rest, 0))
        w = replace(w, id=np.where(tied, last, _ALL))
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        kept: list[list[np.ndarray]] = []
        size = 0

        def first() -> list[np.ndarray]:
            """The first k of each window among those kept, in case rows of one id repeat without bound."""
            at, i, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((i, -s, at))
            at, i, s = at[order], i[order], s[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            return [at[place < k], i[place < k], s[place < k]]

        for ids, labels, v in _batches(batches, len(w.ids)):
            s, admitted = w.cells(v, labels, ids)
            for p in range(w.per):
                own = slice(p, None, w.per)
                bound = w.score[own, None]
                a, r = np.nonzero(admitted & (s <= w.high[own, None]) & ((s > bound) | ((s == bound) & (ids[None, :] <= w.id[own, None]))))
                kept.append([a * w.per + p, ids[r], s[a, r]])
                size += len(a)
            if size > 2 * k * len(w.score) + _CELLS:
                kept = [first()]
                size = len(kept[0][0])
        if kept:
            at, i, s = first()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(i), pa.array(s)], ["w", "id", "score"])

    gathered = rows.mapInArrow(gather, "w int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id"))
    return gathered.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(anchors: DataFrame) -> Iterator[list]:
    """Lists of BLOCK anchors; the driver holds one at a time, and the partition it comes from."""
    block = []
    for row in anchors.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def mine(table: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), one row for each negative.

    A component x counts as floor(scale * x) and a score is the integer inner product with the
    anchor; higher scores come first, of equal ones the smaller id. The positives of an anchor
    are its first ``positives`` other rows of the same label, all if there are fewer. For each,
    the first k rows of another label whose score lies from low % to high % of the positive's
    are given; a window without a row gives none. Anchors are the rows for which ``is_anchor``,
    a condition on columns of ``table``, holds.

    Rows with a null id, a null label, a null vector or a null or non-finite component take no
    part. Labels are integers. Other rows of an anchor's own id aren't its positives; of several anchors of one id
    the one with the smallest label and vector counts. Further repeated rows count each, so a
    negative may come twice with two ranks. Vectors of different lengths, or scores of 2**53 or
    more, raise a ValueError. An empty table gives an empty one.

    Each block of BLOCK anchors takes about eight passes over the vectors. To the driver come a block
    of anchors with their vectors, its positives, and one digit for each window and round.
    """
    spark = table.sparkSession
    usable = table.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull())
    found = integer_vectors(usable.select(F.col(id_column).alias("i"), F.col(vector).alias("x"), F.struct(F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).alias("l")), scale, "i", "x", "l")
    rows = found.select("id", F.col("label.label").alias("label"), "v")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    length = one_length(rows)
    if length is None:
        return spark.createDataFrame([], schema)
    least, most, top = rows.agg(F.min("id"), F.max("id"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    bound = length * (top or 0) ** 2
    if bound >= 1 << 53:
        raise ValueError("scores are too large to be exact")
    anchors = found.filter("label.anchor").groupBy("id").agg(F.min(F.struct("label.label", "v")).alias("x")).select("id", "x.*")
    any_anchor = False
    folder = posixpath.join(shared_folder(spark), f"negatives-{uuid.uuid4().hex}")
    for block in _blocks(anchors):
        any_anchor = True
        a = np.array([r["v"] for r in block], np.float64).reshape(len(block), length)
        ids, labels = np.array([r["id"] for r in block], np.int64), np.array([r["label"] for r in block], np.int64)
        none = np.zeros(0, np.int64)
        near = select(rows, Windows(a, labels, ids, 1, True, np.full(len(block), -bound), np.full(len(block), bound), none, none), positives, (least, most)).collect()
        lower, upper = np.ones(len(block) * positives, np.int64), np.zeros(len(block) * positives, np.int64)
        named = []
        for r in near:
            at = r["w"] * positives + r["rank"] - 1
            lower[at], upper[at] = -(-low * r["score"] // 100), high * r["score"] // 100
            named.append((at, int(ids[r["w"]]), r["id"], r["score"]))
        chosen = select(rows, Windows(a, labels, ids, positives, False, lower, upper, none, none), k, (least, most))
        pairs = spark.createDataFrame(named, "w int, anchor_id long, positive_id long, positive_score long")
        chosen.join(F.broadcast(pairs), "w").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder) if any_anchor else spark.createDataFrame([], schema)
