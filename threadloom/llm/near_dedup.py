"""Near-duplicate documents by SetSketch registers.

A register of a set is the rounded logarithm, to a base near 1, of the minimum of one
exponentially distributed hash over the set; registers are truncated to 16 bits. They are
mergeable (by maximum) and agree in two sets about as often as the sets overlap, so bands
of registers find candidates. For a candidate pair the counts of larger, smaller and equal
registers give the likelihood of the Jaccard similarity jointly with the known set sizes;
pairs far below the threshold drop out, the others are verified on their full sets.

Documents of equal sets are one class and only its first takes part. Within a bucket no
pairs are spelled out: all members are compared with one hub, the one that meets most
documents over all its buckets. Buckets whose members are in one component by then need no
more. The others are cut into tiles of a bounded number of members, and numpy compares the
parity bitmaps of members of different components within a tile. Such a bitmap has a bit for
each hash bucket that an odd number of shingles falls into, so two of them differ in at most
as many bits as the sets differ in shingles: pairs whose bitmaps differ in more than the
threshold allows can't be links, whatever the hash. Only the rest leave the task, so no link
within a bucket that could join two components is left out and groups of documents just
below the threshold make no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bits import bitmap, contains
from threadloom.llm.common import checkpoint, fresh, row_key
from threadloom.llm.graph import components
from threadloom.llm.tokens import chunks, mix, shingle_sets

SHINGLE = 5
#: 32 bands of 4 registers: a pair at similarity 0.75 shares no band with a probability of 5e-6.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: SetSketch's base, rate and largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Pairs are verified if their estimate is at least the threshold less this: five standard deviations at 0.75.
MARGIN = 0.2
#: Bits of a parity bitmap, and the members of a bucket that meet in one tile: twice BLOCK at most, but for the spread of a hash.
PARITY_BITS, BLOCK = 2048, 1024
#: Pairs of bitmaps that are compared at once: 16 MB.
PAIRS_AT_ONCE = 1 << 16

_RNG = np.random.default_rng(20220711)
_XOR = _RNG.integers(1 << 32, size=REGISTERS, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(1 << 31, size=REGISTERS, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SALT, _PARITY_SALT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def registers(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sketches (sets, REGISTERS) of sets that aren't empty: shingles[bounds[d]:bounds[d + 1]]."""
    low = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.empty((REGISTERS, len(bounds) - 1), np.uint32)
    for i in range(REGISTERS):
        v = (low ^ _XOR[i]) * _MUL[i]
        v ^= v >> np.uint32(15)
        least[i] = np.minimum.reduceat(v, bounds[:-1])
    uniform = (least.T.astype(np.float64) + 0.5) / 2.0**32
    exponential = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches (pairs, REGISTERS), given the sizes of the sets.

    The log-likelihood is concave; its maximum is found by golden section for all pairs at once.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(u - v * j), p(v - u * j)
        term = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0.0)
        return term(more, x) + term(less, y) + term(same, 1 - x - y)

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = likelihood(c) > likelihood(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def parity(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The parity bitmaps (sets, PARITY_BITS / 64) of sets: shingles[bounds[d]:bounds[d + 1]]."""
    n = len(bounds) - 1
    at = np.repeat(np.arange(n), np.diff(bounds)) * PARITY_BITS + (mix(shingles ^ _PARITY_SALT) % np.uint64(PARITY_BITS)).astype(np.int64)
    at, times = np.unique(at, return_counts=True)
    odd = np.zeros(n * PARITY_BITS, bool)
    odd[at[times % 2 == 1]] = True
    return np.packbits(odd).view(np.uint64).reshape(n, -1)


def may_reach(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these bitmaps and sizes can have 100 * shared >= percent * union. Never false for sets that have.

    The union less the shared shingles, which is at least the number of bits that differ, is
    at most (n_a + n_b) * (100 - percent) / (100 + percent) for such sets.
    """
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return (differ * (100 + percent) <= (n_a + n_b) * (100 - percent)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for row, words in chunks(batch.column(1), lower=True):
            s, bounds = shingle_sets(words, SHINGLE)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            keys, sketch = np.zeros((len(size), BANDS), np.uint64), np.zeros((len(size), REGISTERS), np.uint16)
            if len(some):
                cut = np.append(bounds[some], bounds[-1])
                sketch[some] = registers(s, cut)
                f1[some] = np.add.reduceat(mix(s), cut[:-1])
                f2[some] = np.add.reduceat(mix(s ^ _SALT), cut[:-1])
                keys += np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mix(keys ^ (sketch[:, r::ROWS].astype(np.uint64) + (np.uint64(r + 1) << np.uint64(32))))
            bits = parity(s, bounds)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            columns = [ids[row : row + len(size)], batch.column(2)[row : row + len(size)], pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands, pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["ord", "doc_id", "n", "f1", "f2", "bands", "sketch", "bits"])


def _sets(involved):
    """(ord, shingles) of the documents whose id may be in a bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = involved.value
        for batch in batches:
            batch = batch.filter(pa.array(contains(known, batch.column(1).to_numpy().view(np.uint64))))
            for row, words in chunks(batch.column(2), lower=True):
                s, bounds = shingle_sets(words, SHINGLE)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + len(sets)], sets], names=["ord", "shingles"])

    return run


def _stacked(column: pa.Array, kind: type) -> np.ndarray:
    """A column of binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _likely(least: float, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, s_a, s_b, p_a, p_b = batch.columns
            n_a, n_b = n_a.to_numpy(), n_b.to_numpy()
            keep = np.flatnonzero(may_reach(_stacked(p_a, np.uint64), _stacked(p_b, np.uint64), n_a, n_b, percent)) if len(batch) else np.zeros(0, int)
            if len(keep):
                x, y = _stacked(s_a.take(pa.array(keep)), np.uint16), _stacked(s_b.take(pa.array(keep)), np.uint16)
                keep = keep[estimate_jaccard(x, y, n_a[keep].astype(float), n_b[keep].astype(float)) >= least]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).take(pa.array(keep))

    return run


def _compare(ids: np.ndarray, component: np.ndarray, side: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """The pairs (2, pairs) of one tile between its two sides and different components that may be links."""
    left, right = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))  # on the diagonal both sides are the same: 2
    step, found = max(1, PAIRS_AT_ONCE // max(1, len(right))), []
    for k in range(0, len(left), step):
        x, y = (v.reshape(-1) for v in np.meshgrid(left[k : k + step], right, indexing="ij"))
        other = component[x] != component[y]
        x, y = x[other], y[other]
        keep = may_reach(bits[x], bits[y], n[x], n[y], percent)
        x, y = ids[x[keep]], ids[y[keep]]
        found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)


def _tiles(percent: int):
    """Pairs that may be links, from rows (key, t, u, side, ord, component, n, bits) that are sorted by tile."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        tile = np.stack([rows[c].to_numpy() for c in ("key", "t", "u")])
        cuts = np.flatnonzero(np.append(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(0)), True))
        side, ids, component, n = (rows[c].to_numpy() for c in ("side", "ord", "component", "n"))
        bits = _stacked(rows["bits"], np.uint64)
        found = [_compare(ids[i:j], component[i:j], side[i:j], n[i:j], bits[i:j], percent) for i, j in zip(cuts[:-1], cuts[1:]) if j > i + 1]
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last tile, which may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            tile = np.stack([batch.column(c).to_numpy() for c in range(3)])
            last = int(np.flatnonzero((tile != tile[:, -1:]).any(0)).max(initial=-1)) + 1
            first = tuple(tile[:, 0])
            if last or held and first != tuple(held[-1].column(c)[len(held[-1]) - 1].as_py() for c in range(3)):
                yield flush([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield flush(held)

    return run


def _open_pairs(placed: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of different components that share a bucket and may be links by their bitmaps.

    placed: (key, ord, size, component). known: (ord, n, bits). A bucket of more than BLOCK members
    is dealt into blocks by a hash, and every two of its blocks meet in a tile.
    """
    open_ = checkpoint(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    left = placed.join(open_, "key").withColumn("own", F.pmod(F.xxhash64("ord"), blocks).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    tiled = left.select("key", F.least("own", "met").alias("t"), F.greatest("own", "met").alias("u"), side.alias("side"), "ord", "component").join(known, "ord")
    dealt = tiled.select("key", "t", "u", "side", "ord", "component", "n", "bits").repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")
    return dealt.mapInArrow(_tiles(percent), "a long, b long").distinct()


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the similarity."""
    side = lambda x: sketches.select(F.col("ord").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"), F.col("bits").alias(f"p_{x}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b", "p_a", "p_b")
    likely = checkpoint(known.mapInArrow(_likely(percent / 100 - MARGIN, percent), "a long, b long"))
    ids = likely.select(F.xxhash64("a").alias("h")).union(likely.select(F.xxhash64("b")))
    sets = texts.select("ord", F.xxhash64("ord").alias("h"), "text").mapInArrow(_sets(bitmap(ids, "h")), "ord long, shingles array<long>").dropDuplicates(["ord"])
    both = likely.join(sets.select(F.col("ord").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("ord").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return checkpoint(both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))


def _settle(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after more links. Only what joins different components is contracted again."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    step = components(links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = labels.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return checkpoint(moved.select("node", F.coalesce("to", "component").alias("component")).union(step.join(labels, "node", "left_anti").select("node", "component")))


def link(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(ord, doc_id, n, component) of every row: its key, its id, the set's size and the smallest key that is reachable.

    Keys are of the id and the text, so rows without an id, or of one id and other texts, are linked each by its own set.
    See ``near_duplicates`` for the rules.
    """
    texts = docs.select(row_key().alias("ord"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    sketches = checkpoint(texts.mapInArrow(_sketch, "ord long, doc_id long, n long, f1 long, f2 long, bands array<long>, sketch binary, bits binary"))
    classes = checkpoint(sketches.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("ord").alias("rep")))
    firsts = classes.select("f1", "f2", "n", F.col("rep").alias("ord"))
    of_firsts = lambda *columns: sketches.select("f1", "f2", "n", "ord", *columns).join(firsts, ["f1", "f2", "n", "ord"], "left_semi")
    by_id = of_firsts("sketch", "bits").select("ord", "n", "sketch", "bits").dropDuplicates(["ord"])

    keys = checkpoint(of_firsts("bands").select("ord", F.explode("bands").alias("key")).distinct())
    shared = checkpoint(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    members = checkpoint(keys.join(shared, "key").select("key", "ord", "size"))
    # the hub is the member that meets most others over all its buckets: copies that differ from each other still link with it
    weights = members.groupBy("ord").agg(F.sum("size").alias("weight"))
    hubs = members.join(weights, "ord").groupBy("key").agg(F.max(F.struct("weight", (-F.col("ord")).alias("o"))).alias("best")).select("key", (-F.col("best.o")).alias("hub"))

    met = members.join(checkpoint(hubs), "key").filter("ord <> hub")
    tested = checkpoint(met.select(F.least("hub", "ord").alias("a"), F.greatest("hub", "ord").alias("b")).distinct())
    # copies hang on the first of their class
    copies = sketches.filter("n > 0").select("f1", "f2", "n", "ord").join(classes, ["f1", "f2", "n"]).filter("ord <> rep").select(F.col("rep").alias("a"), F.col("ord").alias("b"))
    labels = components(_verified(tested, by_id, texts, percent).union(copies))
    placed = members.join(labels.select(F.col("node").alias("ord"), "component"), "ord", "left").select("key", "ord", "size", F.coalesce("component", "ord").alias("component"))
    pairs = checkpoint(_open_pairs(placed, by_id.select("ord", "n", "bits"), percent).join(tested, ["a", "b"], "left_anti"))
    labels = _settle(labels, _verified(pairs, by_id, texts, percent))
    found = sketches.select("ord", "doc_id", "n").join(labels.select(F.col("node").alias("ord"), "component"), "ord", "left")
    return checkpoint(found.select("ord", "doc_id", "n", F.coalesce("component", "ord").alias("component")))


def _fold(found: DataFrame) -> DataFrame:
    """``found`` (ord, doc_id, n, component) with the components that hold rows of one doc_id made one."""
    apart = checkpoint(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("doc_id", "lo"))
    if not apart.limit(1).count():
        return found
    step = components(found.join(apart, "doc_id").select(F.col("lo").alias("a"), F.col("component").alias("b")))
    moved = found.join(step.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return checkpoint(moved.select("ord", "doc_id", "n", F.coalesce("to", "component").alias("component")))


def _with_first(found: DataFrame) -> DataFrame:
    """``found`` with the id and the key of its component's first row: that of the smallest id, nulls last, then of the smallest key."""
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ord")).alias("f"))
    return found.join(checkpoint(first.select("component", F.col("f.doc_id").alias("first_id"), F.col("f.ord").alias("first"))), "component")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Words are lower-cased (A-Z) and split at ASCII white space. A document's set has its distinct
    5-word shingles, or one of all its words if they are fewer; without words or text it is empty
    and linked with nothing. Documents with 100 * shared >= percent * union are linked, and
    component_id is the smallest doc_id that links reach. Rows of one doc_id count as one document,
    with the links of all their texts. Each text without a doc_id is a document of its own; if its
    component has no id, its component_id is null and one of the component's texts is kept.
    Repeated rows each get a row; extra columns are ignored; an empty table gives none.
    """
    kept = F.when(F.col("doc_id").isNull(), F.col("ord") == F.col("first")).otherwise(F.col("doc_id") == F.col("first_id"))
    return _with_first(_fold(link(docs, percent))).select("doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One text of each component; all columns stay as they are. Of rows that repeat an id and its text all stay.

    Rows of one doc_id, or of none, with other texts are judged each by its own text.
    """
    name = fresh("gone")
    gone = _with_first(link(docs, percent)).filter("ord <> first").select(F.col("ord").alias(name)).distinct()
    return docs.join(gone, row_key() == F.col(name), "left_anti").select(*docs.columns)
