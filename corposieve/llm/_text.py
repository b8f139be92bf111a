"""Vectorised words and shingles over Arrow string columns (numpy; no row-at-a-time Python).

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are folded to a-z. Words are held as 64-bit
hashes: a sum of random byte values times powers of an odd number, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_RNG = np.random.default_rng(20240601)
_VALUE = _RNG.integers(1, 2**64, 256, dtype=U)
_ODD = int(_RNG.integers(1, 2**63, dtype=U)) * 2 + 1
_INVERSE = pow(_ODD, -1, 2**64)
_WINDOW = 1 << 17
_powers = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            step = U(pow(base, len(_powers[k]), 2**64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers[0][:n], _powers[1][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``len(column) + 1`` offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``most`` bytes of text; a longer text comes alone."""
    _, offsets = bytes_of(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    data: np.ndarray  # bytes of these texts alone, not of the batch that they are a part of
    offsets: np.ndarray  # of texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each text's words; one more than texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array, fold: bool = True, space: np.ndarray = SPACE) -> Words:
    data, offsets = bytes_of(column)
    low, high = int(offsets[0]), int(offsets[-1])
    part = data[low:high]
    inside = ~space[part]
    start, end = inside.copy(), inside.copy()
    if len(part):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        k = offsets[:-1][full] - low
        start[k] = inside[k]
        k = offsets[1:][full] - 1 - low
        end[k] = inside[k]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), U)
    value = _VALUE[FOLD] if fold else _VALUE
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _WINDOW, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        power, inverse = _power(b - a)
        total = np.empty(b - a + 1, U)
        total[0] = 0
        np.cumsum(value[part[a:b]] * power, out=total[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        hashes[at:to] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15)
        at = to
    first = np.searchsorted(starts, offsets - low, "left")
    return Words(part, offsets - low, starts, ends, mix(hashes), first)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size``-word shingles, each text's sorted, and offsets of texts.

    A text with fewer words has its whole sequence as one shingle; without words it has none.
    """
    n = len(w.hashes)
    rolled = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        rolled = mix(rolled + w.hashes[k : k + len(rolled)] + U(k + 1))
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(rolled[a : b - size + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = np.zeros(1, U)
            for k in range(b - a):
                x = mix(x + w.hashes[a + k : a + k + 1] + U(k + 1))
        else:
            x = w.hashes[:0]
        sets.append(x)
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64)))
    return (np.concatenate(sets) if sets else w.hashes[:0]), offsets
