"""Text columns of Arrow batches as numpy arrays: bytes, words and their hashes.

All functions work on a slice of a batch, cut by size, so that the arrays of eight bytes
per byte of text stay small however long the texts of a batch are together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: every bit of the result depends on every bit of the value."""
    values = values ^ (values >> _U64(30))
    values = values * _U64(0xBF58476D1CE4E5B9)
    values ^= values >> _U64(27)
    values *= _U64(0x94D049BB133111EB)
    values ^= values >> _U64(31)
    return values


def constants(count: int, salt: int = 0) -> np.ndarray:
    """Fixed odd 64-bit numbers, made by rule."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _U64(_BASE) + _U64(salt)) | _U64(1)


_BYTE_CODES = constants(256, 1)
_STEP = int(constants(1, 2)[0])
_WORD_FACTORS = constants(64, 3)

# Byte classes: words end at ASCII white space; items of letters and digits end at all other ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True
LETTER = ALPHANUMERIC.copy()
LETTER[0x30:0x3A] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class _Powers:
    """Powers of a 64-bit number, kept and grown on demand."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.known = np.ones(1, np.uint64)

    def upto(self, count: int) -> np.ndarray:
        if len(self.known) < count:
            factors = np.full(max(count, SLICE_BYTES + 1), self.base, np.uint64)
            factors[0] = 1
            self.known = np.cumprod(factors)
        return self.known[:count]


_up, _down = _Powers(_STEP), _Powers(pow(_STEP, -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its texts; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, offsets, data = filled.buffers()
    if len(filled) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to limit bytes together; a longer text is a range of its own."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(first + 1, min(last, count))
        yield first, last
        first = last


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice: its range of rows, its bytes and the offsets in them."""
    data, offsets = text_bytes(column)
    for first, last in slices(offsets, limit):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


@dataclass
class Words:
    """starts, ends: byte positions of words; text t has the words bounds[t] to bounds[t + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        counts = np.diff(self.bounds)
        return np.repeat(np.arange(len(counts)), counts)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes that lie in one text (or line: whatever the offsets bound)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _up.upto(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * _down.upto(len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def prefix_hashes(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each byte a hash of the bytes from begin to before it; its high bits are the good ones."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * _up.upto(len(data)), out=total[1:])
    return (total[:-1] - total[begin]) * _down.upto(len(data))[begin] * _U64(_BASE)


def sequence_hashes(hashes: np.ndarray, bounds: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash per sequence bounds[i] to bounds[i + 1] of hashes; order counts."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + _U64(salt)) * _up.upto(len(hashes)), out=total[1:])
    lengths = np.diff(bounds).astype(np.uint64)
    return mix((total[bounds[1:]] - total[bounds[:-1]]) * _down.upto(len(hashes) + 1)[bounds[:-1]] + lengths)


def left_out_hashes(hashes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each index in left the sequence hash (see above) of its sequence, owner, without this one hash."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * _up.upto(len(hashes)), out=total[1:])
    first, last = bounds[owner[left]], bounds[owner[left] + 1]
    rest = total[left] - total[first] + (total[last] - total[left + 1]) * _down.upto(2)[1]
    return mix(rest * _down.upto(len(hashes) + 1)[first] + (last - first - 1).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the index of the first word of each."""
    count = len(hashes) - k + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:count] == owner[k - 1 :])
    total = np.zeros(count, np.uint64)
    for j in range(k):
        total += hashes[j : j + count] * _WORD_FACTORS[j]
    return mix(total[first] + _U64(k)), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of k-word shingles of each text, sorted, and the bounds of the sets.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words has
    its whole sequence as one shingle, a text without words an empty set.
    """
    data = LOWER[data]
    found = words(data, offsets, NOT_SPACE)
    hashes, owner, count = span_hashes(data, found.starts, found.ends), found.owner, np.diff(found.bounds)
    values, first = gram_hashes(hashes, owner, k)
    owners = owner[first]
    for fewer in range(1, k):
        short = np.flatnonzero(count == fewer)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(fewer):
                total += hashes[found.bounds[short] + j] * _WORD_FACTORS[j]
            values, owners = np.append(values, mix(total + _U64(fewer))), np.append(owners, short)
    if (count < k).any():
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    bounds = np.searchsorted(owners, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[bounds]
