"""Substring deduplication by repeated-phrase automata.

A window is 13 consecutive words of one document. A word goes if a window over it also
starts in a document with a smaller doc_id.

1. Anchors. Each window names its 5-word run of the smallest hash. Equal windows name the
   same anchor, so only windows whose anchor occurs in two documents can recur. About one
   run in five is an anchor, so this looks at the whole corpus for a fifth of its words.
2. Passages. The runs of windows under one recurring anchor are dealt into shards by anchor.
   An anchor with very many occurrences is dealt over several tasks, which all get its
   distinct passages, aggregated before. If even these are very many, as around a short
   line that stands everywhere, its windows are dealt by their own hash, and only those whose
   hash two documents have.
3. Automata. A shard confirms which of its windows truly occur, word by word, in two
   documents, and compiles these into an Aho-Corasick automaton over word numbers, each with
   its first document.
4. Streaming. The passages of all documents run through the automata of their shards.
5. Removal. The located ranges go back to their documents; the texts of documents without
   any stay where they are.

Hashes only select what is looked at. What is removed is decided by the automata, on words.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bits import bitmap, contains
from threadloom.llm.common import checkpoint
from threadloom.llm.tokens import Words, chunks, mix, windows

WINDOW, ANCHOR = 13, 5
#: Passages that a shard of ordinary anchors compiles and streams, about: few enough that its automaton stays in a core's cache.
SHARD = 4_000
#: Occurrences of a frequent anchor that go to one task, about, beside its distinct passages. Anchors with over half as many are dealt over tasks.
PER_SHARD = 20_000
#: Words, or places of windows, that one step of a shard holds at once, about.
AT_ONCE = 1 << 18
#: Distinct passages of such an anchor that go to each of its tasks, at most: about 30 MB. Those of an anchor with more are dealt by window.
WIDE = 200_000
#: Such anchors that are broadcast, at most; beyond it they are joined by shuffle.
BROADCAST_ANCHORS = 100_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a chunk: the hash of its anchor, its first word and its text."""
    grams, at, _ = windows(hashes, words.first, ANCHOR)
    dense = np.full(len(hashes) + WINDOW, _NONE, np.uint64)
    dense[at] = grams
    span, reach = WINDOW - ANCHOR + 1, 1
    least = dense
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        rest = span - reach
        least = np.minimum(least[: len(least) - rest], least[rest:])
    doc = words.doc_of_word()
    n = len(hashes) - WINDOW + 1
    start = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
    return least[start], start, doc[start]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, words in chunks(batch.column(2)):
            anchor, _, doc = _anchors(words, words.hashes())
            new = np.flatnonzero(_changes(anchor, doc))
            yield pa.RecordBatch.from_arrays(_longs(anchor[new], ids[row + doc[new]]), names=["anchor", "ord"])


def _emit_passages(recurring):
    """(anchor, ord, digest, first word, text) of the runs of windows under one recurring anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = recurring.value
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, words in chunks(batch.column(2)):
                anchor, start, doc = _anchors(words, words.hashes())
                keep = np.flatnonzero(contains(known, anchor))
                if not len(keep):
                    continue
                anchor, start, doc = anchor[keep], start[keep], doc[keep]
                new = _changes(anchor, doc) | np.concatenate([[True], np.diff(start) != 1])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(start)]]) - 1
                b, e = words.begin[start[first]], words.end[start[last] + WINDOW - 1]
                size = e - b
                bounds = np.concatenate([[0], np.cumsum(size)])
                data = words.data[np.repeat(b - bounds[:-1], size) + np.arange(bounds[-1])]
                text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                d = doc[first]
                columns = [*_longs(anchor[first], ids[row + d], digests[row + d], start[first] - words.first[d]), text]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "ord", "digest", "at", "text"])

    return run


def _cut_windows(recurring=None):
    """From (x, y, at, text): each window as (hash, x, y, at), or those whose hash may be in a bitmap as (hash, x, y, their first word, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = [batch.column(i).to_numpy() for i in range(3)]
            for row, words in chunks(batch.column(3)):
                h, start, doc = windows(words.hashes(), words.first, WINDOW)
                if recurring is not None:
                    keep = np.flatnonzero(contains(recurring.value, h))
                    h, start, doc = h[keep], start[keep], doc[keep]
                x, y, at = (c[row + doc] for c in longs)
                columns = _longs(h, x, y, at if recurring is None else at + start - words.first[doc])
                if recurring is not None:
                    b, size = words.begin[start], words.end[start + WINDOW - 1] - words.begin[start]
                    bounds = np.concatenate([[0], np.cumsum(size)])
                    data = words.data[np.repeat(b - bounds[:-1], size) + np.arange(bounds[-1])]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=["window", "x", "y", "at", "text"][: len(columns)])

    return run


def number_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a binary column as numbers that are equal where the words are, and the bounds of its texts."""
    numbers, bounds = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    known: dict[bytes, int] = {}
    for _, words in chunks(column):
        size = words.end - words.begin
        ends = np.concatenate([[0], np.cumsum(size)])
        data = words.data[np.repeat(words.begin - ends[:-1], size) + np.arange(ends[-1])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).dictionary_encode()
        own = np.array([known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()], np.int64)
        numbers.append(own[coded.indices.to_numpy()])
        bounds.append(bounds[-1][-1] + words.first[1:])
    return np.concatenate(numbers), np.concatenate(bounds)


def compile_automaton(numbers: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[ahocorasick.Automaton | None, np.ndarray, np.ndarray]:
    """The automaton of the windows of these texts that occur in two documents, the first document of each, and their sorted hashes.

    Windows are grouped by a hash of their numbers; one that isn't equal to the first of its
    group, number by number, is told apart by its numbers themselves.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    hashes, at, text = windows(mix(numbers.astype(np.uint64)), bounds, WINDOW)
    none = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(at):
        return none
    all_windows = np.lib.stride_tricks.sliding_window_view(numbers, WINDOW)
    _, group, times = np.unique(hashes, return_inverse=True, return_counts=True)
    some = np.flatnonzero((times[group] > 1) | (first[text] < last[text]))  # others occur once, in one document
    hashes, at, text = hashes[some], at[some], text[some]
    _, example, group = np.unique(hashes, return_index=True, return_inverse=True)
    lo, hi = np.full(len(example), np.iinfo(np.int64).max), np.full(len(example), np.iinfo(np.int64).min)
    apart: dict[tuple[int, ...], tuple[int, int]] = {}
    for a in range(0, len(at), 1 << 16):  # a bounded number of windows at once
        w, g, t = at[a : a + (1 << 16)], group[a : a + (1 << 16)], text[a : a + (1 << 16)]
        same = (all_windows[w] == all_windows[at[example[g]]]).all(1)
        np.minimum.at(lo, g[same], first[t[same]])
        np.maximum.at(hi, g[same], last[t[same]])
        for i in np.flatnonzero(~same):
            key, x, y = tuple(all_windows[w[i]].tolist()), int(first[t[i]]), int(last[t[i]])
            old = apart.get(key, (x, y))
            apart[key] = (min(x, old[0]), max(y, old[1]))
    owners, confirmed = [], np.flatnonzero(lo < hi)
    for a in range(0, len(confirmed), 1 << 16):
        for key in all_windows[at[example[confirmed[a : a + (1 << 16)]]]].tolist():
            automaton.add_word(tuple(key), len(owners))
            owners.append(lo[confirmed[len(owners)]])
    known = [hashes[example[confirmed]]]
    for key, (x, y) in apart.items():
        if x < y:
            automaton.add_word(key, len(owners))
            owners.append(x)
            known.append(windows(mix(np.array(key, np.uint64)), np.array([0, WINDOW]), WINDOW)[0])
    if not owners:
        return none
    automaton.make_automaton()
    return automaton, np.array(owners, np.int64), np.unique(np.concatenate(known))


def _may_hold(numbers: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which texts have a window of one of these hashes: only they need to run through the automaton."""
    h, _, text = windows(mix(numbers.astype(np.uint64)), bounds, WINDOW)
    found = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    out = np.zeros(len(bounds) - 1, bool)
    out[text[found]] = True
    return out


def _blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about this size together, of one row at least."""
    sums, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + limit, "right")) - 1)
        yield begin, end
        begin = end


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row that each place of these slices belongs to, and the places."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(np.arange(len(size)), size), np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])


def _hits(automaton: ahocorasick.Automaton, numbers: np.ndarray, bounds: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, its word that a window ends at, the window) of these texts; many run through the automaton as one, a number of no word between them."""
    between, size = int(numbers.max(initial=0)) + 1, np.diff(bounds)[texts]
    found = [np.zeros((3, 0), np.int64)]
    for i, j in _blocks(size, AT_ONCE):
        row, at = _spread(bounds[texts[i:j]], size[i:j])
        start = np.concatenate([[0], np.cumsum(size[i:j] + 1)])
        line = np.full(start[-1], between, np.int64)
        line[at - bounds[texts[i:j]][row] + start[row]] = numbers[at]
        stop, window = np.fromiter(itertools.chain.from_iterable(automaton.iter(tuple(line.tolist()))), np.int64).reshape(-1, 2).T
        own = np.searchsorted(start, stop, "right") - 1
        found.append(np.stack([texts[i + own], stop - start[own], window]))
    return tuple(np.concatenate(found, 1))


def _ranges(group: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union, in words, of the windows of each group that end at these words, both sorted: (group, begin, end)."""
    new = _changes(group)
    new[1:] |= np.diff(stops) > WINDOW
    first = np.flatnonzero(new)
    last = np.append(first, len(stops))[1:] - 1
    return group[first], stops[first] - WINDOW + 1, stops[last] + 1


def _locate(passages: pa.Table, occurrences: pa.Table) -> pa.Table:
    """Word ranges of the occurrences that an earlier document has too. Without passages, these are the occurrences' own.

    Equal texts run through the automaton once.
    """
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]  # (occurrence, begin, end)
    ids, digests, at = (occurrences[c].to_numpy() for c in ("ord", "digest", "at"))
    if occurrences.num_rows:
        texts = occurrences["text"].combine_chunks().dictionary_encode()
        which = texts.indices.to_numpy()
        numbers, bounds = number_words(pa.concat_arrays([texts.dictionary, passages["passage"].combine_chunks().cast(pa.binary())]))
        n = len(texts.dictionary)
        if passages.num_rows:
            automaton, owners, known = compile_automaton(numbers[bounds[n] :], bounds[n:] - bounds[n], passages["first"].to_numpy(), passages["last"].to_numpy())
        else:
            lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(lo, which, ids)
            np.maximum.at(hi, which, ids)
            automaton, owners, known = compile_automaton(numbers[: bounds[n]], bounds[: n + 1], lo, hi)
        if automaton is not None:
            may = np.flatnonzero(_may_hold(numbers[: bounds[n]], bounds[: n + 1], known))
            text, stops, window = _hits(automaton, numbers, bounds, may)
            own, hits = owners[window], np.searchsorted(text, np.arange(n + 1))
            least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
            np.minimum.at(least, text, own)
            np.maximum.at(most, text, own)
            of, begin, end = _ranges(text, stops)
            ranges = np.searchsorted(of, np.arange(n + 1))
            whole = np.flatnonzero((least[which] <= most[which]) & (ids > most[which]))  # all its windows stand in earlier documents
            row, place = _spread(ranges[which[whole]], np.diff(ranges)[which[whole]])
            out.append((whole[row], begin[place], end[place]))
            some = np.flatnonzero((ids > least[which]) & (ids <= most[which]))
            size = np.diff(hits)[which[some]]
            for i, j in _blocks(size, AT_ONCE):
                row, place = _spread(hits[which[some[i:j]]], size[i:j])
                row = some[i + row]
                earlier = own[place] < ids[row]
                out.append(_ranges(row[earlier], stops[place[earlier]]))
    row, begin, end = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.Table.from_arrays(_longs(ids[row], digests[row], at[row] + begin, at[row] + end), names=["ord", "digest", "begin", "end"])


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, ranges) or, where nothing goes, (doc_id, text)."""
    for batch in batches:
        n_words, n_removed, digests = [], [], []
        for i, text in enumerate(batch.column(1)):
            w = (text.as_py() or b"").split()
            n = len(w)
            found = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            if found:
                keep = bytearray(b"\x01") * n
                for r in found:
                    keep[r["begin"] : r["end"]] = bytes(r["end"] - r["begin"])
                w = [x for x, k in zip(w, keep, strict=True) if k]
            n_words.append(n)
            n_removed.append(n - len(w))
            digests.append(hashlib.sha256(b" ".join(w)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _maybe(touched, wanted: bool):
    """Rows whose last column, a hash, may be in a bitmap, or those where it can't be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = touched.value
        for batch in batches:
            yield batch.filter(pa.array(contains(known, batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)) == wanted))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """A null doc_id counts as larger than any; rows are told apart by id and text."""
    ord_: Column = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    return docs.select(ord_.alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), "doc_id")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(ord, digest, begin, end): word ranges of documents that occur in earlier documents, as the automata locate them."""
    keyed = _keyed(docs).select("ord", "digest", "text")
    anchors = keyed.mapInArrow(_emit_anchors, "anchor long, ord long").groupBy("anchor").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count("*").alias("n"))
    anchors = checkpoint(anchors.filter("lo < hi").select("anchor", "n"))
    under = lambda known: keyed.mapInArrow(_emit_passages(bitmap(known, "anchor")), "anchor long, ord long, digest long, at long, text binary")
    occurrences = under(anchors)

    shards = max(1, -(-(anchors.agg(F.sum("n")).first()[0] or 0) // SHARD))
    hot = checkpoint(anchors.filter(2 * F.col("n") > PER_SHARD).select("anchor", F.ceil(2 * F.col("n") / PER_SHARD).alias("tasks")))
    small = F.broadcast if hot.count() <= BROADCAST_ANCHORS else (lambda df: df)
    passages = under(hot).join(small(hot), "anchor").groupBy("anchor", "tasks", F.col("text").alias("passage")).agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("n"))
    passages = checkpoint(passages)
    # of these anchors, those whose distinct passages would be too many to go to each task
    wide = passages.groupBy("anchor").agg(F.count("*").alias("passages")).filter(F.col("passages") > WIDE).select("anchor", F.lit(True).alias("wide"))
    hot = checkpoint(hot.join(wide, "anchor", "left").withColumn("wide", F.coalesce("wide", F.lit(False))))
    dealt = occurrences.join(small(hot), "anchor", "left")
    # anchors of many occurrences get negative shards, their own, and a task for each share of them
    cold, own = F.pmod(F.xxhash64("anchor"), F.lit(shards)), F.col("anchor").bitwiseOR(F.lit(-(1 << 63)))
    spread = passages.join(small(hot.filter("NOT wide").select("anchor")), "anchor").select(own.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "passage", "first", "last")
    own_tasks = F.coalesce(F.pmod(F.xxhash64("ord", "at"), "tasks"), F.lit(0))
    narrow = dealt.filter("wide IS NULL OR NOT wide").select(F.when(F.col("tasks").isNull(), cold).otherwise(own).alias("shard"), own_tasks.alias("task"), "ord", "digest", "at", "text")
    if hot.filter("wide").limit(1).count():
        more, rows = _wide_windows(passages.join(small(hot.filter("wide").select("anchor")), "anchor"), dealt.filter("wide"))
        spread, narrow = spread.unionByName(more), narrow.unionByName(rows)
    by = ["shard", "task"]
    return spread.groupBy(*by).cogroup(narrow.groupBy(*by)).applyInArrow(_locate, "ord long, digest long, begin long, end long")


def _wide_windows(passages: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The windows of these passages and occurrences whose hash two documents have, dealt by that hash.

    A shard has about PER_SHARD distinct windows; its automaton goes to a task for each PER_SHARD
    of its occurrences. So rows grow with the occurrences, whatever recurs how often.
    """
    each = passages.select("first", "last", "n", F.col("passage").alias("text")).mapInArrow(_cut_windows(), "window long, x long, y long, at long")
    found = each.groupBy("window").agg(F.min("x").alias("lo"), F.max("y").alias("hi"), F.sum("at").alias("times")).filter("lo < hi")
    found = checkpoint(found.select("window", "times"))
    shards = max(1, -(-found.count() // PER_SHARD))
    known = bitmap(found, "window")
    shard = -1 - F.pmod(F.xxhash64("window"), F.lit(shards))
    loads = checkpoint(found.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("times") / PER_SHARD).alias("tasks")))
    small = F.broadcast if shards <= BROADCAST_ANCHORS else (lambda df: df)
    schema = "window long, x long, y long, at long, text binary"
    distinct = passages.select("first", "last", "n", F.col("passage").alias("text")).mapInArrow(_cut_windows(known), schema)
    distinct = distinct.groupBy("window", F.col("text").alias("passage")).agg(F.min("x").alias("first"), F.max("y").alias("last")).withColumn("shard", shard).join(small(loads), "shard")
    spread = distinct.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "passage", "first", "last")
    rows = occurrences.select("ord", "digest", "at", "text").mapInArrow(_cut_windows(known), schema).withColumn("shard", shard).join(small(loads), "shard")
    return spread, rows.select("shard", F.pmod(F.xxhash64("x", "at"), "tasks").alias("task"), F.col("x").alias("ord"), F.col("y").alias("digest"), "at", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    Words are runs of anything but ASCII white space, compared as they are. Documents of fewer
    than 13 words keep all. Rows of one doc_id don't count against each other; a null doc_id
    counts as the largest, a null text has no words. Repeated rows each get a row; extra columns
    are ignored; an empty table gives no rows.
    """
    found = checkpoint(repeated_ranges(docs).groupBy("ord", "digest").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")))
    touched = bitmap(found.select(F.xxhash64("ord", "digest").alias("h")), "h")
    keyed = _keyed(docs).withColumn("h", F.xxhash64("ord", "digest"))
    untouched = keyed.select("doc_id", "text", "h").mapInArrow(_maybe(touched, False), "doc_id long, text binary, h long").select("doc_id", "text").mapInArrow(_remove, _RESULT)
    rest = keyed.select("doc_id", "ord", "digest", "text", "h").mapInArrow(_maybe(touched, True), "doc_id long, ord long, digest long, text binary, h long")
    return untouched.unionByName(rest.join(found, ["ord", "digest"], "left").select("doc_id", "text", "ranges").mapInArrow(_remove, _RESULT))
