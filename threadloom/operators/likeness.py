"""Joins of sets that are alike, within blocks.

Sets over a small alphabet, such as the bigrams of texts, share most of their members whether
alike or not, so an index by member finds nearly all pairs, each of them many times over. Here
rows are ordered by block and size and cut into runs; two runs meet in a tile if they share a
block and sets of their sizes can be alike at all, and each tile is a task's work: products of
0-1 matrices that give the sizes of all intersections. A block of any size falls into tiles of
a bounded one, many small blocks share a tile, and only what qualifies leaves a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import strip
from threadloom.sources.scratch import written

#: Rows of a run and of a side of a product, a power of two. Where runs are more than RUNS, up to 2^LONGER of them count as one, so that rows are sent to fewer tiles.
RUN, RUNS, LONGER = 1024, 256, 2
#: Members whose columns of the matrices are made at once.
_COLUMNS = 2048
#: Pairs whose bigrams are sorted at once.
_PAIRS = 2048


def bigram_sets(df: DataFrame, id_col: str, block: str, text: str, as_is: bool = False) -> DataFrame:
    """(block, id, grams array<long>): the distinct pairs of neighbouring characters of the text, lower-cased and stripped unless ``as_is``, each as a number.

    Rows without a block or with fewer than two characters are left out.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for t in batch.column(2).to_pylist():
                c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
                grams.append(np.unique(c[:-1] << 21 | c[1:]))
            bounds = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["block", "id", "grams"])

    given = df.select(F.col(block).alias("block"), F.col(id_col).alias("id"), (F.col(text) if as_is else F.lower(strip(F.col(text)))).alias("t")).filter(F.col("block").isNotNull() & (F.length("t") >= 2))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    return given.mapInArrow(pairs, f"block {kinds['block']}, id {kinds['id']}, grams array<long>")


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of each pair of neighbouring characters, and the pair as a number; null has none."""
    texts = pc.fill_null(texts, "")
    row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    c = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    inside = row[:-1] == row[1:]
    return row[:-1][inside], (c[:-1] << 21 | c[1:])[inside]


def _jaccards(a: pa.Array, b: pa.Array) -> np.ndarray:
    (ra, ga), (rb, gb) = _grams(a), _grams(b)
    kinds, kind = np.unique(np.concatenate([ga, gb]), return_inverse=True)
    width = max(1, len(kinds))
    x, y = np.unique(ra * width + kind[: len(ga)]), np.unique(rb * width + kind[len(ga) :])
    count = lambda keys: np.bincount(keys // width, minlength=len(a))
    both = count(np.intersect1d(x, y, assume_unique=True))
    union = count(x) + count(y) - both
    return both / np.maximum(union, 1)


def pair_likeness(a: Column, b: Column, stripped: bool = True) -> Column:
    """``text.bigram_jaccard`` of the two texts of each row, for many rows: a batch's bigrams are sorted at once, not made one by one."""

    def like(x: pa.Array, y: pa.Array) -> pa.Array:
        parts = [_jaccards(x.slice(k, _PAIRS), y.slice(k, _PAIRS)) for k in range(0, len(x), _PAIRS)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    clear = strip if stripped else (lambda t: t)
    # else a filter on the result would have it computed a second time
    return F.arrow_udf(like, "double").asNondeterministic()(F.lower(clear(a)), F.lower(clear(b)))


def _packed(flat: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """The sets of ``n`` rows as binary: the differences of their sorted members, in groups of 7 bits; all but a member's last byte have the high bit."""
    flat = flat.astype(np.int64, copy=False).view(np.uint64)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    step = np.diff(flat, prepend=flat[:1])
    first = np.diff(row, prepend=-1) != 0
    step[first] = flat[first]
    size = np.ones(len(step), np.int64)
    for k in range(1, 10):
        size += step >= np.uint64(1 << 7 * k)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[(end - size)[some] + k] = (step[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, size, n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def _unpacked(packed: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The members of the packed sets, one after the other."""
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    if not len(packed):
        return np.zeros(0, np.uint64)
    data = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    start = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(start, np.diff(start, append=len(data)))
    step = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)
    total, first = np.cumsum(step), np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - step[first], sizes)


def _runs(sets: DataFrame, column: str) -> DataFrame:
    """(block, id, n, packed) of the rows that aren't empty, with the run that each is in."""
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            flat = batch.column(2).flatten().to_numpy()
            packed = _packed(flat, np.repeat(np.arange(len(batch)), sizes), len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int32()), packed], ["block", "id", "n", "packed"])

    held = sets.filter(F.size("grams") > 0).select("block", "id", "grams").mapInArrow(pack, f"block {kinds['block']}, id {kinds['id']}, n int, packed binary")
    placed = written(held.repartitionByRange("block", "n", "id").sortWithinPartitions("block", "n").withColumn(column, F.shiftright(F.monotonically_increasing_id(), RUN.bit_length() - 1)))
    longer = min(LONGER, max(0, (placed.count() // (RUN * RUNS)).bit_length()))
    return placed.withColumn(column, F.shiftright(column, longer))


def _tiles(sets: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """(ca, cb, side, block, id, n, packed): the rows of every pair of runs with a block in which their sizes can be alike, of ``sets`` or of ``sets`` and ``others``; a run that meets itself comes once, as side 0.

    Ids of ``others``, which may be of another type, are in a column ``other``.
    """
    ranges = lambda placed, c: placed.groupBy("block", c).agg(F.min("n").alias(f"lo_{c}"), F.max("n").alias(f"hi_{c}"))
    placed = _runs(sets, "ca")
    placed_b = placed.withColumnRenamed("ca", "cb") if others is None else _runs(others, "cb")
    near = f"hi_cb >= {least} * lo_ca AND hi_ca >= {least} * lo_cb" + (" AND ca <= cb" if others is None else "")
    # by runs alone: these are few, whatever the number of blocks
    tiles = written(ranges(placed, "ca").join(ranges(placed_b, "cb"), "block").filter(near).select("ca", "cb").distinct())
    first = placed.join(tiles, "ca").withColumn("side", F.lit(0))
    second = placed_b.join(tiles.filter("ca < cb") if others is None else tiles, "cb").withColumn("side", F.lit(1))
    if others is not None:
        second = second.withColumnRenamed("id", "other").withColumn("id", F.lit(None).cast(sets.schema["id"].dataType))
        first = first.withColumn("other", F.lit(None).cast(others.schema["id"].dataType))
    columns = ["ca", "cb", "side", "block", "id", *(["other"] if others is not None else []), "n", "packed"]
    return first.select(*columns).unionByName(second.select(*columns))


def _compared(tile: pa.Table, least: float, of_larger: bool = False) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of one side, of the other, row and column of each pair of one block that is alike, its similarity)."""
    own = tile.filter(pc.equal(tile["side"], 0))
    other = tile.filter(pc.equal(tile["side"], 1))
    alone = not other.num_rows
    # blocks that only one side has meet nobody
    if not alone:
        own, other = own.filter(pc.is_in(own["block"], other["block"])), other.filter(pc.is_in(other["block"], own["block"]))
    both = (own,) if alone else (own, other)
    codes = pa.concat_arrays([t["block"].combine_chunks() for t in both]).dictionary_encode().indices.to_numpy()
    sides, at = [], 0
    for t in both:
        code, n = codes[at : at + t.num_rows], t["n"].to_numpy()
        order, at = np.lexsort((n, code)), at + t.num_rows
        sides.append((t.take(pa.array(order)), code[order], n[order].astype(np.int64)))
    member, place = np.unique(np.concatenate([_unpacked(t["packed"].combine_chunks(), n) for t, _, n in sides]), return_inverse=True)
    cells, at = [], 0
    for _, code, n in sides:
        ends = np.cumsum(n)
        cells.append((code, n, np.concatenate([[0], ends]), place[at : at + int(n.sum())]))
        at += int(n.sum())
    cells = cells * 2 if alone else cells

    def part(cell: tuple, rows: slice, c: int) -> np.ndarray:
        _, n, bounds, columns = cell
        column, row = columns[bounds[rows.start] : bounds[rows.stop]] - c, np.repeat(np.arange(rows.stop - rows.start), n[rows])
        inside = (column >= 0) & (column < _COLUMNS)
        m = np.zeros((rows.stop - rows.start, min(_COLUMNS, len(member) - c)), np.float32)
        m[row[inside], column[inside]] = 1
        return m

    cuts = [[slice(k, min(k + RUN, len(cell[0]))) for k in range(0, len(cell[0]), RUN)] for cell in cells]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for i in cuts[0]:
        for j in cuts[1]:
            (code_a, size_a), (code_b, size_b) = ((cell[0][r], cell[1][r]) for cell, r in zip(cells, (i, j), strict=True))
            far = code_a[0] == code_a[-1] == code_b[0] == code_b[-1] and (size_b[-1] < least * size_a[0] or size_a[-1] < least * size_b[0])
            if far or code_a[-1] < code_b[0] or code_b[-1] < code_a[0] or (alone and j.start < i.start):
                continue
            shared = np.zeros((len(code_a), len(code_b)))
            for c in range(0, len(member), _COLUMNS):
                shared += part(cells[0], i, c) @ part(cells[1], j, c).T
            x, y = size_a[:, None], size_b[None, :]
            union = np.maximum(x, y) if of_larger else x + y - shared
            alike = (shared >= least * union) & (code_a[:, None] == code_b[None, :])
            a, b = np.nonzero(np.triu(alike, 1) if alone and i.start == j.start else alike)
            found.append((a + i.start, b + j.start, shared[a, b] / union[a, b]))
    a, b, similarity = (np.concatenate(x) for x in zip(*found, strict=True))
    return sides[0][0], sides[-1][0], a, b, similarity


def _pairs(tile: pa.Table, least: float, names: tuple[str, str], of_larger: bool = False) -> pa.Table:
    """(block, two ids by ``names``, similarity) of the pairs of a tile."""
    own, other, a, b, similarity = _compared(tile, least, of_larger)
    own, other = own.take(pa.array(a)), other.take(pa.array(b))
    return pa.table({"block": own["block"], names[0]: own["id"], names[1]: other["other" if "other" in other.column_names else "id"], "similarity": pa.array(similarity)})


def like_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(block, id_a, id_b, similarity): pairs of one block's sets (block, id, grams) with a Jaccard similarity of ``least`` or more, id_a < id_b.

    Sets are arrays of distinct longs; empty ones are like none. Ids are distinct within a block.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}

    def compare(tile: pa.Table) -> pa.Table:
        return _pairs(tile, least, ("a", "b"))

    found = _tiles(sets, least).groupBy("ca", "cb").applyInArrow(compare, f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, similarity double")
    return found.select("block", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity")


def like_between(sets: DataFrame, others: DataFrame, least: float, of_larger: bool = False) -> DataFrame:
    """(block, id, other, similarity): pairs of a set and one of ``others``, both (block, id, grams), of one block with a similarity of ``least`` or more: Jaccard's, or what they share of the larger set."""
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    other = others.schema["id"].dataType.simpleString()

    def compare(tile: pa.Table) -> pa.Table:
        return _pairs(tile, least, ("id", "other"), of_larger)

    return _tiles(sets, least, others).groupBy("ca", "cb").applyInArrow(compare, f"block {kinds['block']}, id {kinds['id']}, other {other}, similarity double")


def like_counts(sets: DataFrame, least: float) -> DataFrame:
    """(block, id, links): how many sets of its block each set is like; those like none are absent. No pair leaves its tile."""
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}

    def count(tile: pa.Table) -> pa.Table:
        x, y, a, b, _ = _compared(tile, least)
        left, right = np.bincount(a, minlength=len(x)), np.bincount(b, minlength=len(y))
        linked = pa.concat_tables([x.take(pa.array(np.flatnonzero(left))), y.take(pa.array(np.flatnonzero(right)))])
        return pa.table({"block": linked["block"], "id": linked["id"], "links": pa.array(np.concatenate([left[left > 0], right[right > 0]]))})

    by_tile = _tiles(sets, least).groupBy("ca", "cb").applyInArrow(count, f"block {kinds['block']}, id {kinds['id']}, links long")
    return by_tile.groupBy("block", "id").agg(F.sum("links").alias("links"))
