"""Numpy views of text columns and the small kernels the operators share.

Everything here works on one Arrow batch, or on a block of it, inside a task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels take at once: a few arrays of eight bytes a
#: position stay small beside an executor's memory.
BLOCK = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes; a longer text is a range."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def byte_values() -> np.ndarray:
    """A fixed random-looking value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


#: Powers by base, as many as were asked for so far; ``give_back`` drops them.
_KNOWN_POWERS: dict[int, np.ndarray] = {}


def _powers(length: int, base: int) -> np.ndarray:
    powers = np.full(length, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers, out=powers)


def _powers_to(length: int, base: int) -> np.ndarray:
    if length > BLOCK:
        return _powers(length, base)
    known = _KNOWN_POWERS.get(base)
    if known is None or len(known) < length:
        known = _KNOWN_POWERS[base] = _powers(1 << max(length - 1, 0).bit_length(), base)
    return known[:length]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of a sequence of values."""
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers_to(len(values), _BASE), out=running[1:])
    spans = (running[ends] - running[starts]) * _powers_to(len(values) + 1, _INVERSE)[starts]
    return mix(spans ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` values, by doubling."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    done, have, part, size, rest = None, 0, values, 1, width
    while True:
        if rest & 1:
            if done is None:
                done, have = part, size
            else:
                n = min(len(done), len(part) - have)
                done = done[:n] * np.uint64(pow(_BASE, size, 2**64)) + part[have : have + n]
                have += size
        rest >>= 1
        if not rest:
            return mix(done[: len(values) - width + 1])
        n = len(part) - size
        part = part[:n] * np.uint64(pow(_BASE, size, 2**64)) + part[size : size + n]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of ``width`` values, by doubling."""
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of many ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary_array(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from one buffer and n + 1 offsets."""
    raw = pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), raw]
    ).cast(pa.binary())


def columns(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its length and type."""
    out = []
    for array in arrays:
        array = np.ascontiguousarray(array)
        out += [np.array([ord(array.dtype.char), array.nbytes], np.int64).tobytes(), array.tobytes()]
    return b"".join(out)


def from_columns(blob: bytes) -> list[np.ndarray]:
    """What ``columns`` has put together."""
    out, at, view = [], 0, memoryview(blob)
    while at < len(view):
        kind, size = np.frombuffer(view[at : at + 16], np.int64)
        out.append(np.frombuffer(view[at + 16 : at + 16 + int(size)], np.dtype(chr(kind))))
        at += 16 + int(size)
    return out


def give_back() -> None:
    """Return freed memory to the machine: workers are used again, by other stages too."""
    _KNOWN_POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(work: Callable) -> Callable:
    """A function over the batches of a task that gives memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def tidy_group(work: Callable) -> Callable:
    """The same for a function over one group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    return run


def tidy_pair(work: Callable) -> Callable:
    """The same for a function over two groups of one key."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            give_back()

    return run


class UnionFind:
    """Classes of small integers; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
