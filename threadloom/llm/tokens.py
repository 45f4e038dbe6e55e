"""Words of many texts at once, in numpy: spans, hashes and shingles of an Arrow column.

A word's hash mixes its bytes eight at a time, each step after the first on a mixed state,
so that no arrangement of letters makes words collide by construction. Hashes only choose
candidates or compare sets within a pair.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once, if one text isn't longer; it bounds the arrays below.
CHUNK_BYTES = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 1024

_U = np.uint64
_SEED = _U(0x9E3779B97F4A7C15)
_SHINGLE = _U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: The bytes of a lane of eight that belong to a word, by how many are left of it.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a run of texts. ``first[d]:first[d + 1]`` are the words of text d."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        size = self.end - self.begin
        out = mix(size.astype(_U) + _SEED)
        lanes = np.ndarray(len(self.data) + 1, "<u8", np.append(self.data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        rest, done = np.flatnonzero(size <= LONG_WORD), 0
        while len(rest):  # the words that have more bytes, eight further
            left = size[rest] - done
            out[rest] = mix(out[rest] ^ (lanes[self.begin[rest] + done] & _LANE[np.minimum(left, 8)]))
            rest, done = rest[left > 8], done + 8
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.begin[i] : self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(column: pa.Array, lower: bool = False):
    """(first row, Words) of slices of a binary or string column; null counts as empty."""
    data, offsets = offsets_of(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        own = data[offsets[row] : offsets[last]]
        yield row, split_words(_LOWER[own] if lower else own, offsets[row : last + 1] - offsets[row])
        row = last


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # two texts may meet within a run of letters
    met = cuts[inside[cuts] & inside[cuts + 1]]
    starts[met] = ends[met] = True
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, begin, end, np.searchsorted(begin, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text: (hash, index of the first word, text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _SHINGLE
        h += hashes[j : j + n]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at, doc[at]


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and their bounds; a text of fewer than k words has one, of all its words."""
    h = words.hashes()
    s, _, doc = windows(h, words.first, k)
    n = np.diff(words.first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([whole_hash(h[words.first[d] : words.first[d + 1]]) for d in short], _U)
        s, doc = np.concatenate([s, whole]), np.concatenate([doc, short])
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(n) + 1))


def whole_hash(h: np.ndarray) -> int:
    """The one shingle of a text of few words."""
    out = 0x51ED27 + len(h)
    for x in h.tolist():
        out = (out * int(_SHINGLE) + x) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([out], _U))[0])
