"""Vectors as codes: each part of a vector by the number of its nearest codebook entry.

The entries of each part position stand in a vantage-point tree (Yianilos 1993). A search
goes down the tree for all vectors of a batch at once and leaves out a branch only where the
triangle inequality shows that all its entries lie farther than the best so far. All of it is
in integers: distances to vantage points are rounded down and up to whole numbers, whichever
lets more branches in, a branch at the same distance is visited, as it may hold an entry of
a lower index, and distances are compared as exact squares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import checkpoint
from threadloom.llm.vectors import integer_vectors, matrix, one_length

#: Labels whose sums are broadcast; with more, they are joined by a shuffle that deals each label out to SALTS tasks.
BROADCAST_LABELS, SALTS = 50_000, 32
#: Rows that are searched for at once.
_ROWS = 1 << 14


@dataclass
class Node:
    """An entry, and the others on either side of its median distance, with the least and largest distance of each side."""

    entry: int
    sides: list[tuple[int, int, Node]]


def vantage_tree(entries: list[list[int]]) -> Node | None:
    """The tree of all entries. A vantage point is the entry with the widest spread of distances, the first of equal ones."""

    def build(own: list[int]) -> Node | None:
        if not own:
            return None
        squares = {i: {j: sum((a - b) ** 2 for a, b in zip(entries[i], entries[j], strict=True)) for j in own if j != i} for i in own}
        vantage = max(own, key=lambda i: (max(squares[i].values(), default=0) - min(squares[i].values(), default=0), -i))
        rest = sorted(squares[vantage], key=lambda j: (squares[vantage][j], j))
        half = (len(rest) + 1) // 2
        sides = []
        for side in (rest[:half], rest[half:]):
            if side:
                far = squares[vantage][side[-1]]
                sides.append((isqrt(squares[vantage][side[0]]), isqrt(far - 1) + 1 if far else 0, build(side)))
        return Node(vantage, sides)

    return build(list(range(len(entries))))


def nearest(tree: Node, entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each row of ``parts``, the lowest index of equal ones."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.zeros(len(parts), np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        gap = parts[rows] - entries[node.entry]
        square = np.einsum("ij,ij->i", gap, gap)
        better = (square < best[rows]) | ((square == best[rows]) & (node.entry < index[rows]))
        best[rows[better]], index[rows[better]] = square[better], node.entry
        root = np.sqrt(square.astype(np.float64)).astype(np.int64)
        low, high = np.maximum(root - 1, 0), root + 2  # the true distance lies between, however the root was rounded
        bounds = [np.maximum(0, np.maximum(low - most, least - high)) for least, most, _ in node.sides]
        first = np.argmin(bounds, axis=0) if bounds else None
        for turn in range(len(bounds)):  # each row's nearer side first
            for k, (_, _, below) in enumerate(node.sides):
                here = (first == k) if turn == 0 else (first != k)
                here &= bounds[k] ** 2 <= best[rows]
                if here.any():
                    visit(below, rows[here])

    if len(parts):
        visit(tree, np.arange(len(parts)))
    return index, best


def _searched(batch: pa.RecordBatch, place: int, books: list[np.ndarray], trees: list[Node]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch: (rows, vectors by part, entries, squared distances)."""
    for a in range(0, batch.num_rows, _ROWS):
        v = matrix(batch.column(place).slice(a, _ROWS)).astype(np.int64)
        parts = v.reshape(len(v), len(books), -1) if v.size else np.zeros((len(v), len(books), 0), np.int64)
        found = [nearest(t, b, np.ascontiguousarray(parts[:, p])) for p, (b, t) in enumerate(zip(books, trees, strict=True))]
        yield slice(a, a + len(v)), parts, np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _first_entries(vectors: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids; of rows with one id the smallest vector."""
    last = (1 << 63) - 1

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column(0).fill_null(last).to_numpy()
            wanted = np.unique(np.concatenate([np.unique(ids)[:entries], np.array(list(best), np.int64)]))[:entries]
            at = np.flatnonzero(np.isin(ids, wanted))
            for i, v in zip(ids[at].tolist(), batch.column(1).take(pa.array(at)).to_pylist(), strict=True):
                best[i] = min(best.get(i, v), v)
            best = {i: best[i] for i in wanted.tolist()}
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int32()))], ["id", "v"])

    by_task = vectors.select("id", "v").mapInArrow(least, "id long, v array<int>")
    rows = by_task.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _next_books(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of the parts that are nearest to it."""
    trees = [vantage_tree(b.tolist()) for b in books]
    n, d = books[0].shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), n, d + 1), np.int64)
        for batch in batches:
            for _, parts, entry, _ in _searched(batch, 0, books, trees):
                for p in range(len(books)):
                    total[p, :, d] += np.bincount(entry[:, p], minlength=n)
                    for c in range(d):  # sums of integers under 2**24 over _ROWS rows are exact in double precision
                        total[p, :, c] += np.bincount(entry[:, p], parts[:, p, c], n).astype(np.int64)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "total"])

    summed = vectors.select("v").mapInArrow(add, "at long, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {r["at"]: int(r["total"]) for r in summed.collect()}  # a row for each component of the codebooks
    out = []
    for p, book in enumerate(books):
        at = lambda e, c, p=p: total.get((p * n + e) * (d + 1) + c, 0)
        out.append(np.array([[at(e, c) // at(e, d) for c in range(d)] if at(e, d) else book[e].tolist() for e in range(n)], np.int64).reshape(n, d))
    return out


def compress(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every row with a whole vector; the first two keep their names.

    A component x counts as floor(scale * x). Each part position has a codebook of ``entries``
    vectors (at most 256), at first those of the smallest ids; ``rounds`` times every part goes
    to the nearest entry, the lower index of equal ones, and an entry becomes the floor of its
    parts' mean, or stays where it has none. ``code`` has two hexadecimal digits for each part,
    ``error`` is the sum of the squared distances, ``label_error`` its sum over equal labels,
    nulls together, and ``codebooks_sha256`` the digest of the last codebooks.

    Null vectors and those with a null or non-finite component are dropped. With fewer ids than
    entries, a codebook has one for each id; null ids count as one, after all others. Repeated
    rows are coded each. Vectors of different lengths, or of a length that isn't a multiple of
    ``parts``, raise a ValueError. An empty table gives an empty one.

    The driver holds the codebooks alone. A round sums in each task, then by component.
    """
    vectors = integer_vectors(table, scale, id_column, vector, label)
    kind = vectors.schema["label"].dataType.simpleString()
    length = one_length(vectors)
    if length is None:
        return table.sparkSession.createDataFrame([], f"`{id_column}` long, `{label}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if length % parts or not 0 < entries <= 256:
        raise ValueError(f"{length} components can't be cut into {parts} equal parts, or {entries} entries aren't from 1 to 256")
    first = _first_entries(vectors, entries)
    books = [first[:, p * (length // parts) : (p + 1) * (length // parts)] for p in range(parts)]
    for _ in range(rounds):
        books = _next_books(vectors, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    trees = [vantage_tree(b.tolist()) for b in books]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, entry, square in _searched(batch, 2, books, trees):
                codes = entry.astype(np.uint8).tobytes().hex()
                codes = [codes[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(entry))]
                own = batch.slice(rows.start, len(entry))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(codes, pa.string()), pa.array(square.sum(1))], ["id", "label", "code", "error"])

    coded = checkpoint(vectors.mapInArrow(assign, f"id long, label {kind}, code string, error long"))
    sums = checkpoint(coded.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        dealt = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        each = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(each, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    return joined.select(F.col("id").alias(id_column), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
