"""Benchmark decontamination: size-partitioned MinHash containment search.

The question is asymmetric: does a long document contain a short test item? A MinHash of
the whole document would drown the item, so a document is covered by windows about as
long as an item. Items are partitioned by their number of shingles; for each class the
windows are long enough for any passage of an item of that class. Minima are taken over
small blocks once, and a window's sketch is the minimum of its blocks' sketches. Within a
class the containment threshold turns into a Jaccard threshold, and the number of rows in
a band follows from it. Windows that share a band with an item make a candidate pair, and
a pair counts only if the item's shingles, taken exactly, are contained in the document.
Classes of short items take finer blocks. Where even then bands of one row would miss too many
pairs, as for items of under about ten shingles, a class has no sketches: a document is looked
up in a sorted array of its items' rarest shingles.

Items are the stated queries. They are broadcast in blocks of a fixed number, one pass
over the documents for each block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import fresh, row_key, share
from threadloom.llm.tokens import chunks, shingle_sets, whole_hash, windows

SHINGLE = 5
HASHES = 64
#: Shingles of a block, powers of two, for classes of long and of short items; windows begin at blocks.
BLOCKS = (16, 4)
#: The largest ratio of item sizes within a class.
CLASS_RATIO = 1.5
#: Items, and bytes of their texts, that are broadcast at once, at most.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 16 << 20
#: A window is looked at if it may hold this share of what an item needs: an item may be scattered over a few places.
WINDOW_SHARE = 0.5
#: Pairs that are spelled out at once: 8 MB.
HITS_AT_ONCE = 1 << 20
_MISS = 1e-4

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(1 << 32, size=HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(1 << 31, size=HASHES, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def _low(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """The least value of a set under each hash."""
    return ((_low(shingles)[:, None] ^ _XOR) * _MUL).min(0)


def _block_minima(shingles: np.ndarray, doc: np.ndarray, n_docs: int, blocks: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of blocks (powers of two, ascending): the text of each block and its least values (HASHES, blocks).

    Texts are filled up to whole blocks by their last shingle, so that blocks are halves put together.
    """
    count = np.bincount(doc, minlength=n_docs)
    room = -(-count // blocks[-1]) * blocks[-1]
    owner, start = np.repeat(np.arange(n_docs), room), np.cumsum(room) - room
    place = np.minimum(np.arange(len(owner)) - start[owner], count[owner] - 1) + (np.cumsum(count) - count)[owner]
    low, out = _low(shingles)[place], {b: (owner[::b], np.empty((HASHES, len(owner) // b), np.uint32)) for b in blocks}
    for i in range(HASHES):
        value, size = (low ^ _XOR[i]) * _MUL[i], 1
        while size < blocks[-1]:
            value, size = np.minimum(value[::2], value[1::2]), 2 * size
            if size in out:
                out[size][1][i] = value
    return out


def rows_in_band(jaccard: float, hashes: int = HASHES, miss: float = _MISS) -> int:
    """The largest number of rows whose bands miss a pair of this similarity with a probability of at most ``miss``; 0 if one row does not do."""
    best = 0
    for r in range(1, 9):
        if (1 - jaccard**r) ** (hashes // r) <= miss:
            best = r
    return best


class ItemIndex:
    """Items of one pass: exact shingles, and for each size class the values of their bands or, without a loss, their rarest shingles."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float):
        self.ids = np.array([k for k, _ in items], np.int64)
        self.sets: list[np.ndarray] = []
        for _, words in chunks(pa.array([t for _, t in items], pa.binary()), lower=True):
            s, bounds = shingle_sets(words, SHINGLE)
            self.sets += [s[bounds[d] : bounds[d + 1]] for d in range(len(bounds) - 1)]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.need = np.ceil(self.sizes * threshold - 1e-9).astype(np.int64)
        self.classes: list[tuple[int, int, int, list]] = []  # block, blocks of a window, rows of a band, bands
        self.sketches = [_sketch(x) if len(x) else None for x in self.sets]
        exact: list[int] = []
        left = np.flatnonzero(self.sizes > 0)
        left = left[np.argsort(self.sizes[left], kind="stable")]
        while len(left):
            top = int(self.sizes[left[0]] * CLASS_RATIO)
            here, left = left[self.sizes[left] <= top], left[self.sizes[left] > top]
            least, most = int(self.sizes[here].min()), int(self.sizes[here].max())
            held = max(1.0, threshold * WINDOW_SHARE * least)
            for block in BLOCKS:
                blocks = -(-most // block) + 1
                if r := rows_in_band(held / (least + blocks * block - held)):
                    self.classes.append((block, blocks, r, [self._band(here, first, r) for first in range(0, HASHES - r + 1, r)]))
                    break
            else:
                exact += here.tolist()
        self.sketches = []
        self.rare = self._rare(exact)

    def _rare(self, here: list[int]):
        """The rarest shingles of items: as many as must hold one that a text with what the item needs has."""
        known, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *[self.sets[i] for i in here]]), return_counts=True)
        keys, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i in here:
            s = self.sets[i]
            own = s[np.argsort(times[np.searchsorted(known, s)], kind="stable")][: len(s) - max(1, self.need[i]) + 1]
            keys.append(own)
            items.append(np.full(len(own), i))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        return _seen(keys >> np.uint64(48)), keys[order], items[order]

    def _band(self, here: np.ndarray, first: int, r: int):
        values = np.stack([self.sketches[i][first : first + r] for i in here], axis=1)
        keys = fold(values)
        order = np.argsort(keys, kind="stable")
        return _seen(_slot(values)), keys[order], here[order]


def _seen(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[slots] = True
    return out


def _slot(columns: np.ndarray) -> np.ndarray:
    """A number of 16 bits from the values of a band's rows, by which most windows are told apart from all items at once."""
    key = columns[0] * np.uint32(0x9E3779B1)
    for c in columns[1:]:
        key = (key ^ c) * np.uint32(0x85EBCA77)
    return key >> np.uint32(16)


def fold(columns: np.ndarray) -> np.ndarray:
    """One 64-bit key from the values of a band's rows."""
    key = np.full(columns.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        key = (key ^ c) * np.uint64(0xD1342543DE82EF95)
        key ^= key >> np.uint64(32)
    return key * np.uint64(0x9E3779B97F4A7C15)


def _hits(own: np.ndarray, doc: np.ndarray, keys: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """Distinct (text, item) pairs, as text * items + item, of the keys that a table (sorted keys, items) holds."""
    lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
    doc, lo, n = doc[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ends, found, k = np.cumsum(n), [np.zeros(0, np.int64)], 0
    while k < len(doc):  # HITS_AT_ONCE or one key's items at a time
        m = max(k + 1, int(np.searchsorted(ends, ends[k] - n[k] + HITS_AT_ONCE, "right")))
        part = n[k:m]
        found.append(np.unique(np.repeat(doc[k:m], part) * n_items + items[np.repeat(lo[k:m] - np.cumsum(part) + part, part) + np.arange(part.sum())]))
        k = m
    return np.unique(np.concatenate(found))


def _candidates(shingles: np.ndarray, doc: np.ndarray, n_docs: int, index: ItemIndex) -> np.ndarray:
    """Distinct (text, item) pairs, as text * items + item, whose windows share a band or that share a rare shingle."""
    seen, keys, items = index.rare
    at = np.flatnonzero(seen[shingles >> np.uint64(48)])
    found = [_hits(shingles[at], doc[at], keys, items, len(index.ids))]
    if not index.classes or not len(shingles):
        return found[0]
    minima = _block_minima(shingles, doc, n_docs, sorted({c[0] for c in index.classes}))
    for block, blocks, r, bands in index.classes:
        owner, least = minima[block]
        steps, reach = [], 1
        while reach < blocks and reach < len(owner):  # a window takes in the blocks after the one it begins at, within the text
            steps.append(min(reach, blocks - reach))
            reach += steps[-1]
        steps = [(k, np.flatnonzero(owner[k:] != owner[:-k])) for k in steps if k < len(owner)]
        for b, (seen, keys, items) in enumerate(bands):
            own = least[b * r : (b + 1) * r].copy()
            for k, ends in steps:
                wide = np.minimum(own[:, :-k], own[:, k:])
                wide[:, ends] = own[:, ends]
                own[:, :-k] = wide
            at = np.flatnonzero(seen[_slot(own)])
            found.append(_hits(fold(own[:, at]), owner[at], keys, items, len(index.ids)))
    return np.unique(np.concatenate(found))


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "n_item", "n_shared"]
    single = np.flatnonzero(index.sizes == 1).tolist()
    for batch in batches:
        ids = batch.column(0)
        for row, words in chunks(batch.column(1), lower=True):
            n_docs = len(words.first) - 1
            hashes = words.hashes()
            shingles, _, doc = windows(hashes, words.first, SHINGLE)
            pairs = _candidates(shingles, doc, n_docs, index)
            bounds = np.searchsorted(doc, np.arange(n_docs + 1))
            size, few, last = np.diff(words.first), {}, (-1, None)
            for d in np.flatnonzero((size > 0) & (size < SHINGLE)) if len(single) else []:
                # texts of one shingle are compared as they are
                few[d] = np.array([whole_hash(hashes[words.first[d] : words.first[d + 1]])], np.uint64)
                pairs = np.union1d(pairs, [d * len(index.ids) + i for i in single if index.sets[i][0] == few[d][0]]).astype(np.int64)
            out = []
            for p in pairs.tolist():
                d, i = divmod(p, len(index.ids))
                if d != last[0]:  # pairs are sorted by text
                    last = d, few[d] if d in few else np.unique(shingles[bounds[d] : bounds[d + 1]])
                shared = len(np.intersect1d(last[1], index.sets[i], assume_unique=True))
                if shared >= index.need[i]:
                    out.append((row + d, int(index.ids[i]), len(index.sets[i]), shared))
            if out:
                at, item, n_item, shared = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pc.take(ids, pa.array(at)), pa.array(item, pa.int64()), pa.array(n_item, pa.int64()), pa.array(shared, pa.int64())], names=names)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of the items that documents contain.

    Words are lower-cased (A-Z) and split at ASCII white space; sets hold distinct 5-word
    shingles, and a text of fewer words has one shingle of all of them. A pair is returned
    if at least ``threshold`` of the item's shingles occur anywhere in the document. Items
    and documents without words match nothing. Repeated documents and items each match;
    rows with a null doc_id are searched, items with a null id aren't. Extra columns are
    ignored; empty tables give no pairs. Items of size classes for which one-row bands would
    miss more than 1e-4 (those of under about ten shingles) are all found. Of larger ones, the
    candidate search misses an item of which the share ``WINDOW_SHARE * threshold`` lies in one
    place with a probability of about 1e-4 at most, and far less where all of it does; items that
    are scattered in smaller parts over a document may be missed.
    """
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    spark = docs.sparkSession
    found, part, size = [], [], 0

    def one_pass(block: list[tuple[int, bytes]]) -> DataFrame:
        index = share(spark, ItemIndex(block, threshold))  # ITEMS_PER_PASS items of BYTES_PER_PASS at most

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _search(batches, pickle.loads(index.value))

        return texts.mapInArrow(search, "doc_id long, item_id long, n_item long, n_shared long")

    rows = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").cast("binary").alias("text")).orderBy("item_id")
    for r in rows.toLocalIterator():  # a block of queries at a time
        part.append((r["item_id"], bytes(r["text"])))
        size += len(part[-1][1])
        if len(part) >= ITEMS_PER_PASS or size >= BYTES_PER_PASS:
            found.append(one_pass(part))
            part, size = [], 0
    if part or not found:
        found.append(one_pass(part))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The rows whose text contains no item, whatever other rows of their doc_id, or of none, contain; all columns stay as they are."""
    name = fresh("bad")
    bad = contained_items(docs.select(row_key().alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, row_key() == F.col(name), "left_anti").select(*docs.columns)
