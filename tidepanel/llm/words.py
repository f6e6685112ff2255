"""Vectorised word handling over Arrow string columns, shared by the operators of this subpackage.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``. All functions work on the UTF-8
bytes of whole texts; a null text counts as the empty one. Memory is bounded by ``chunks``, which cuts
a column into slices of about a MB (a single longer text makes a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, wraps

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SLICE = 1 << 20  # bytes of text worked on at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return lambda keep: 0


def give_back() -> None:
    """Returns memory that is freed, but kept by Arrow's pool and the C library, to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable) -> Callable:
    """``run`` (batches to batches) for workers that outlive it: it gives freed memory back when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def chunks(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes together, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them (rows + 1, from 0)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: byte spans in ``data`` and, for each text, where its words begin and end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts; with ``lower`` A-Z become a-z (in a copy)."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        begin = offsets[:-1][np.diff(offsets) > 0]
        end = offsets[1:][np.diff(offsets) > 0] - 1
        first[begin] = solid[begin]
        last[end] = solid[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(LOWER[data] if lower else data, starts, ends, np.searchsorted(starts, offsets))


_LOW = 1 << 12


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base`` to the powers 0 to 4,095, and to 4,096 times these."""
    out = []
    for step in (base, pow(base, _LOW, 1 << 64)):
        table = np.full(_LOW, step, dtype=np.uint64)
        table[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(table, out=table)
        out.append(table)
    return out[0], out[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser with good avalanche; each seed gives another permutation."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low, high = _powers(_BASE)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    rows = -(-len(data) // _LOW)
    with np.errstate(over="ignore"):
        terms = np.multiply.outer(high[:rows], low).ravel()[: len(data)]
        terms *= data.astype(np.uint64) + np.uint64(1)
        np.cumsum(terms, out=prefix[1:])
        low, high = _powers(_INVERSE)
        return (prefix[ends] - prefix[starts]) * low[starts & (_LOW - 1)] * high[starts >> 12]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = SLICE) -> np.ndarray:
    """A 64-bit hash of each byte span, in time linear in the bytes: differences of a prefix polynomial.

    Spans come by ascending starts and ends. They are hashed in blocks of about ``most`` bytes, so memory doesn't
    grow with a text; a span that is longer than a block is summed up from parts.
    """
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + most, side="right")))
        if int(ends[to - 1]) - begin <= most:
            out[at:to] = _block_hashes(data[begin : ends[to - 1]], starts[at:to] - begin, ends[at:to] - begin)
        else:  # one long span
            whole = 0
            for a in range(begin, int(ends[at]), most):
                part = data[a : min(a + most, int(ends[at]))]
                whole += int(_block_hashes(part, np.zeros(1, np.int64), np.array([len(part)]))[0]) * pow(_BASE, a - begin, 1 << 64)
            out[at] = whole & (2**64 - 1)
        at = to
    with np.errstate(over="ignore"):
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` of ``words``: runs of the powers of two in ``n``, joined."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size, power, whole, length = 1, words, None, 0
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                count = max(0, len(words) - length - size + 1)
                tail = power[length : length + count]
                whole = tail if whole is None else whole[:count] * np.uint64(0xD1342543DE82EF95) + tail
                length += size
            if size * 2 > n:
                return mix(whole, n)
            power = power[:-size] * np.uint64((0x9E3779B97F4A7C15 * (2 * size + 1)) & (2**64 - 1) | 1) + power[size:]
            size *= 2


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words, from the words' hashes, and the bounds of each text's runs."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    whole = np.ones(len(words) - n + 1, dtype=bool)
    for k in range(1, n):  # runs that would leave their text
        at = bounds[1:] - k
        at = at[at >= bounds[:-1]]
        whole[at[at < len(whole)]] = False
    return run_hashes(words, n)[whole], out
