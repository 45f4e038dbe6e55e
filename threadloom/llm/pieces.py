"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is normalised, taken apart into symbols of one character, and the adjacent pair whose
joined piece has the highest score is merged, the leftmost of equal ones, until no pair forms
a piece. Three things keep this cheap and change no result:

- No merge crosses two characters that are nowhere adjacent inside a piece, so a text is cut
  there into segments that are merged each on their own. Word by word the cut stands before
  the mark of a space, and segments that come again are remembered.
- The agendas of all new segments of a batch run in lockstep, in numpy: in each step each
  segment merges its best pair.
- A segment of more than ``LOCKSTEP`` symbols has an agenda in a heap of its own.

What the library does with the same segments is compared in each batch of rows.
"""

from __future__ import annotations

import codecs
import heapq
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from threadloom.llm.common import share
from threadloom.llm.tokens import CHUNK_BYTES, offsets_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A model file is broadcast; larger ones are refused.
MODEL_BYTES = 64 << 20
#: Symbols of a segment that is merged in lockstep with others.
LOCKSTEP = 40
#: Segments of at most LOCKSTEP characters that a worker remembers, about 200 bytes each, besides those of one run of rows.
REMEMBERED = 1 << 19

_SPACE = "▁"
_SEGMENT = re.compile(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+")
_NONE = np.iinfo(np.int32).max
#: A symbol that is no piece has the number of pieces plus its code point as its number; numbers have so many bits.
_BITS = 22


def _first_byte(error: UnicodeError) -> tuple[str, int]:
    """Each byte that begins no character becomes one replacement mark."""
    return "�", error.start + 1


codecs.register_error("threadloom-byte-by-byte", _first_byte)


class Vocabulary:
    """The pieces of a merge-type model and which pairs of symbols form them."""

    def __init__(self, model: bytes):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces aren't supported")
        self.unknown, self.bytes = lib.unk_id(), [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_bytes = all(lib.is_byte(i) for i in self.bytes)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
        #: Whether normalising only marks spaces and puts one in front.
        self.plain = spec.add_dummy_prefix and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces)
        probe = lib.normalize("a")
        if probe.endswith(_SPACE):
            raise ValueError("models that mark spaces behind a word aren't supported")
        self.prefix, self.strips = probe.startswith(_SPACE), lib.normalize("  a") == probe
        number = {p: i for i, p in enumerate(names) if not special[i]}
        self.of_char = np.arange(0x110000, dtype=np.int64) + n
        for p, i in number.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        symbol = lambda p: number.get(p, n + ord(p) if len(p) == 1 else None)
        scores = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in number.values()}, reverse=True))}
        pairs = {}
        for p, i in number.items():
            for k in range(1, len(p)):
                left, right = symbol(p[:k]), symbol(p[k:])
                if left is not None and right is not None:
                    pairs[left << _BITS | right] = (scores[lib.get_score(i)], i)
        self.pairs = pairs
        self._fill(pairs)
        beside = {(a, b) for p in number for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(ord(a) << _BITS | ord(b) for a, b in beside), np.int64)
        #: Whether words can be cut before each mark of a space.
        self.words = all(b != _SPACE or a == _SPACE for a, b in beside)
        self.surface = [b"" if lib.is_control(i) else " ⁇ ".encode() if i == self.unknown else bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
        self.control = [lib.is_control(i) for i in range(n)]
        #: Pieces whose bytes may follow each other as they are: all but control pieces and bytes that aren't ASCII.
        self.simple = np.array([not lib.is_control(i) and not (lib.is_byte(i) and self.surface[i] > b"\x7f") for i in range(n)])
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.flat_size = np.array([len(x) for x in self.surface], np.int64)
        self.flat_start = np.cumsum(self.flat_size) - self.flat_size
        self.spaced = [p.startswith(_SPACE) and not s for p, s in zip(names, special, strict=True)]
        self.memory: dict[str, bytes] = {}

    # -- encoding ------------------------------------------------------------------------

    def _fill(self, pairs: dict[int, tuple[int, int]]) -> None:
        """The pairs as a table with open addresses, a quarter full at most, for many lookups at once."""
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        keys = np.array(list(pairs), np.int64)
        self.keys = np.full((1 << bits) + len(pairs) + 1, -1, np.int64)  # a run of taken places may reach beyond the end
        self.ranks, self.merged = np.full(len(self.keys), _NONE, np.int32), np.zeros(len(self.keys), np.int64)
        for key, at in zip(keys.tolist(), self._place(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at] = key
            self.ranks[at], self.merged[at] = pairs[key]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair, or a free one."""
        key = left << _BITS | right
        at = self._place(key)
        found = self.keys[at]
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            at[rest] += 1
            found = self.keys[at[rest]]
            rest = rest[(found != key[rest]) & (found >= 0)]
        return at

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.ranks[self._lookup(left, right)]

    def _ids(self, symbols: list[int]) -> bytes:
        """The ids of a segment's last symbols as int32; what is no piece goes by its bytes, or counts as unknown."""
        out = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.by_bytes:
                out += [self.bytes[b] for b in chr(s - self.size).encode()]
            else:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def lockstep(self, segments: list[str]) -> list[bytes]:
        """The ids of segments of at most LOCKSTEP characters, each as the bytes of an int32 array."""
        out: list[bytes] = [b""] * len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        # rows are segments with n symbols left; those that merge go on among the segments of n - 1
        sym, rank, own = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int32), np.zeros(0, np.int64)
        for n in range(int(lengths.max(initial=0)), 0, -1):
            new = np.flatnonzero(lengths == n)
            fresh = symbols[starts[new][:, None] + np.arange(n)]
            ranks = self._rank(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(len(new), n - 1)
            if len(own):
                sym, rank, own = np.concatenate([sym, fresh]), np.concatenate([rank, ranks]), np.concatenate([own, new])
            else:
                sym, rank, own = fresh, ranks, new
            if n > 1:
                j = rank.argmin(1)  # the leftmost of equal ones
                goes_on = rank[np.arange(len(own)), j] < _NONE
            else:
                j, goes_on = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
            ended = sym[~goes_on]
            plain, blob = (ended < self.size).all(1).tolist(), ended.astype(np.int32).tobytes()
            for k, at in enumerate(own[~goes_on].tolist()):
                out[at] = blob[4 * n * k : 4 * n * (k + 1)] if plain[k] else self._ids(ended[k].tolist())
            sym, rank, own, j = sym[goes_on], rank[goes_on], own[goes_on], j[goes_on]
            if not len(own):
                sym, rank = np.zeros((0, max(0, n - 1)), np.int64), np.zeros((0, max(0, n - 2)), np.int32)
                continue
            rows = np.arange(len(own))
            at = self._lookup(sym[rows, j], sym[rows, j + 1])
            keep = np.arange(n - 1) + (np.arange(n - 1) > j[:, None])
            sym = np.take_along_axis(sym, keep, 1)
            sym[rows, j] = self.merged[at]
            if n > 2:
                keep = np.arange(n - 2) + (np.arange(n - 2) >= j[:, None])
                rank = np.take_along_axis(rank, keep, 1)
                some = np.flatnonzero(j > 0)
                rank[some, j[some] - 1] = self._rank(sym[some, j[some] - 1], sym[some, j[some]])
                some = np.flatnonzero(j < n - 2)
                rank[some, j[some]] = self._rank(sym[some, j[some]], sym[some, j[some] + 1])
            else:
                rank = np.zeros((len(own), 0), np.int32)
        return out

    def agenda(self, segment: str) -> bytes:
        """The ids of a segment of any length, by a heap of pairs: score, then place. About 150 bytes a character."""
        sym = self.of_char[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        size, after, before = [1] * n, [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def add(i: int, j: int) -> None:
            found = self.pairs.get(sym[i] << _BITS | sym[j]) if i >= 0 and j >= 0 else None
            if found is not None:
                heapq.heappush(heap, (found[0], i, size[i] + size[j]))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j < 0 or size[i] + size[j] != both:
                continue  # one of the two has been merged since
            sym[i], size[i], size[j], after[i] = self.pairs[sym[i] << _BITS | sym[j]][1], both, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            add(before[i], i)
            add(i, after[i])
        return self._ids([s for s, k in zip(sym, size, strict=True) if k])

    def _cut(self, segment: str) -> list[str]:
        """A long segment, cut between characters that are nowhere adjacent inside a piece."""
        chars = np.frombuffer(segment.encode("utf-32-le"), np.uint32).astype(np.int64)
        key = chars[:-1] << _BITS | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, key), max(0, len(self.beside) - 1))
        apart = self.beside[at] != key if len(self.beside) else np.ones(len(key), bool)
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encoded(self, segments: list[str]) -> list[bytes]:
        long = [k for k, s in enumerate(segments) if len(s) > LOCKSTEP]
        if not long:
            return self.lockstep(segments)
        parts = [self._cut(segments[k]) for k in long]
        for k in long:
            segments[k] = ""
        out = self.lockstep(segments + [p for own in parts for p in own if len(p) <= LOCKSTEP])
        done = iter(out[len(segments) :])
        for k, own in zip(long, parts, strict=True):
            segments[k] = "".join(own)
            out[k] = b"".join([next(done) if len(p) <= LOCKSTEP else self.agenda(p) for p in own])
        return out[: len(segments)]

    def _compare(self, segments: list[str], ids: list[bytes]) -> None:
        """What the library makes of the segments that begin with the mark of a space, which it puts in front itself."""
        if not self.prefix or self.strips:
            return
        some = [k for k, s in enumerate(segments) if s[0] == _SPACE and len(s) > 1]
        theirs = self.library.encode([segments[k][1:] for k in some], num_threads=1)
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()))
        ours = [ids[k] if self.by_bytes else self._collapsed(np.frombuffer(ids[k], np.int32)).tobytes() for k in some]
        if b"".join(ours) != flat.tobytes() or (np.fromiter(map(len, ours), np.int64, len(ours)) != 4 * sizes).any():
            at = next(k for k, x in enumerate(ours) if np.frombuffer(x, np.int32).tolist() != theirs[k])
            raise ValueError(f"the library encodes {segments[some[at]][:80]!r} as {theirs[at][:40]}")

    def _collapsed(self, ids: np.ndarray) -> np.ndarray:
        """Runs of unknown symbols count as one."""
        if self.by_bytes or len(ids) < 2:
            return ids
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again]

    def encode(self, texts: list[str], check: bool = True) -> list[np.ndarray]:
        """The ids of each text."""
        normal = [f"{_SPACE}{t.replace(' ', _SPACE)}" if t else "" for t in texts] if self.plain else self.library.normalize(texts)
        cut = [_SEGMENT.findall(t) if self.words else ([t] if t else []) for t in normal]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.memory))
        ids = self._encoded(new)
        if check:
            self._compare(new, ids)
        self.memory.update(zip(new, ids, strict=True))
        of = self.memory.__getitem__
        out = [self._collapsed(np.frombuffer(b"".join(map(of, own)), np.int32)) for own in cut]
        for s in [s for s in new if len(s) > LOCKSTEP]:
            del self.memory[s]
        return out

    # -- decoding ------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: the space in front goes, bytes that form no character become marks."""
        if not ids:
            return ""
        first = 0
        while first < len(ids) and self.control[ids[first]]:
            first += 1
        surface = self.surface
        rest = ids[first:]
        head = b""
        if self.prefix or self.strips:
            while rest and self.spaced[rest[0]]:
                own = surface[rest[0]][1:]
                rest = rest[1:]
                head = own
                if own or not self.strips:
                    break
                while rest and self.control[rest[0]]:
                    rest = rest[1:]
        text = lambda part: b"".join([surface[i] for i in part]).decode("utf-8", "threadloom-byte-by-byte")
        marks = [k for k, i in enumerate(rest) if self.control[i]]  # bytes on either side of one form no character
        return head.decode() + "".join([text(rest[a:b]) for a, b in zip([0, *marks], [*marks, len(rest)], strict=True)])


    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ``ids[bounds[d] : bounds[d + 1]]``; texts of whole characters are gathered at once."""
        n = len(bounds) - 1
        other = np.concatenate([[0], np.cumsum(~self.simple[ids])])[bounds]
        slow = (np.diff(other) > 0) | self.strips
        size = self.flat_size[ids]
        own = np.repeat(np.arange(n), np.diff(bounds))
        size[slow[own]] = 0
        begin = self.flat_start[ids].copy()
        heads = bounds[:-1][(np.diff(bounds) > 0) & ~slow]
        heads = heads[np.array(self.spaced)[ids[heads]]] if self.prefix else heads[:0]
        begin[heads] += 1  # the space in front
        size[heads] -= 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        blob = self.flat[np.repeat(begin - ends + size, size) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[bounds]
        if not slow.any():
            return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(blob))
        texts = [self.decode(ids[bounds[d] : bounds[d + 1]].tolist()) if slow[d] else blob[offsets[d] : offsets[d + 1]].tobytes().decode() for d in range(n)]
        return pa.array(texts, pa.string())


@lru_cache(maxsize=2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _shared(docs: DataFrame, model: str):
    with open(model, "rb") as file:
        content = file.read(MODEL_BYTES + 1)
    if len(content) > MODEL_BYTES:
        raise ValueError(f"the model has over {MODEL_BYTES} bytes")
    _vocabulary(content)  # raises here what isn't supported
    return share(docs.sparkSession, content)


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, end) of runs of rows of about CHUNK_BYTES; a longer row is a run of its own."""
    if pa.types.is_list(column.type):
        offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]) * 4
    else:
        _, offsets = offsets_of(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end
        row = end


def encode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """(id_column, ids): the ids of every row's whole text, without begin or end ids; a null text counts as empty.

    The model file is read on the driver and broadcast, at most MODEL_BYTES. With ``check`` each
    task encodes the segments that it meets with the library too, and raises where it differs;
    as no piece reaches over a cut, texts agree where their segments do. Nothing is shuffled.
    Rows that repeat are encoded each; an empty table gives an empty one.
    """
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(pickle.loads(shared.value))
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                ids = vocabulary.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], check)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, id_column: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(id_column, ids, decoded): the text of every row's ids; null ids and null elements count as absent."""
    shared = _shared(encoded, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(pickle.loads(shared.value))
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                own = batch.slice(a, b - a)
                found = own.column(1).flatten()
                there = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
                bounds = there[np.concatenate([[0], np.cumsum(own.column(1).value_lengths().fill_null(0).to_numpy())])]
                texts = vocabulary.decode_all(found.drop_null().to_numpy(), bounds)
                yield pa.RecordBatch.from_arrays([*own.columns, texts], ["id", "ids", "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(F.col(id_column).alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnsRenamed({"id": id_column, "ids": ids})
