"""Vectorised word kernels over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; all six are
ASCII, so UTF-8 texts are cut at byte level.  Every function works on whole
texts; nulls count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_C1, _C2, _BASE = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53), _U(0x9E3779B97F4A7C15)
_MASKS = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _C1
    x ^= x >> _U(29)
    x = x * _C2
    x ^= x >> _U(32)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column (8 zero bytes after them) and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        raw[: hi - lo] = np.frombuffer(column.buffers()[2], dtype=np.uint8)[lo:hi]
    return raw, offsets - lo


@dataclass
class Words:
    """Words of several texts in order; ``first`` has n + 1 word numbers, one per text."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    size = int(offsets[-1])
    if size == 0:
        none = np.zeros(0, np.int64)
        return Words(raw, offsets, none, none, np.zeros(len(offsets), np.int64))
    word = ~SPACE[raw[:size]]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < size)]
    starts[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    start = np.flatnonzero(starts)
    return Words(raw, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def hash_words(w: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step.

    A step is one to one in its eight bytes and in what was before, so words of
    one length that differ in one step only never meet.
    """
    if not len(w.start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(w.raw) - 7,), dtype="<u8", buffer=w.raw, strides=(1,))
    length = w.end - w.start
    h = np.full(len(length), seed, np.uint64) * _BASE
    active = np.flatnonzero(length <= LONG_WORD)
    at = w.start[active]
    left = length[active]
    while len(active):
        block = eight[at] & _MASKS[np.minimum(left, 8)]
        h[active] = mix((h[active] ^ block) * _BASE)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    h += length.astype(np.uint64) * _C1
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(w.raw[w.start[i] : w.end[i]].tobytes(), seed)
    return h


def window_hashes(h: np.ndarray, n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A hash of each n consecutive word hashes; texts' bounds are not looked at."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc *= base
        acc += h[j : j + m]
    return mix(acc)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Word numbers at which a window of n words begins that lies in one text."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    return expand(first[:-1], count)


def expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... of count[i] numbers each, one after the other."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(count) - count
    return np.arange(total) + np.repeat(begin - ahead, count)


def slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``target`` bytes each; one text is never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def part(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = int(offsets[i]), int(offsets[j])
    return raw[lo : hi + 8], offsets[i : j + 1] - lo
