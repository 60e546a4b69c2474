"""Vectorised views of Arrow text columns: words, hashes, bounded slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Text bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1, int64) and UTF-8 bytes of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have at most `most` bytes; a longer text comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, min(2 * len(_powers), SLICE_BYTES + 1))
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        base[0] = inverse[0] = 1
        _powers, _inverses = np.cumprod(base), np.cumprod(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Prefix:
    """64-bit hashes of any byte spans of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        _grow(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * _inverses[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and each text's range among them (n + 1)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags over each range of offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and the number of the word where each begins."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = hashes[: n - size + 1].copy()
    for k in range(1, size):
        h *= np.uint64(0x9FB21C651E98DF25)
        h += hashes[k : n - size + 1 + k]
    left = np.repeat(first[1:], np.diff(first))[: n - size + 1] - np.arange(n - size + 1)
    at = np.flatnonzero(left >= size)
    return mix(h[at]), at


def row_ids(n_per: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(n_per)), n_per)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal keys (the first n_keys columns, without null), also across batches."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> list:
        return [batch.column(k)[i].as_py() for k in range(n_keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(n_keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            change |= column[1:] != column[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_resident: dict[tuple, Any] = {}
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Give freed memory back to the system, where the libraries can: a few milliseconds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def trim() -> None:
    """give_back(), with what only the cycle collector frees."""
    gc.collect()
    give_back()


def drop_resident() -> None:
    """Forget what resident() keeps, and give its memory back."""
    if _resident:
        _resident.clear()
        trim()


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks: one object, made when another is first asked for.

    Workers serve many stages; tables that one operator filled must not stay while another runs.
    """
    if key not in _resident:
        drop_resident()
        _resident[key] = make()
        trim()
    return _resident[key]


def lean(run: Run, tables: bool = False) -> Run:
    """run for mapInArrow, in a worker that holds no freed memory between batches and idles on little afterwards.

    Without tables of its own, it first drops those that another operator left.
    """

    @wraps(run)
    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tables:
            drop_resident()
        for out in run(batches):
            yield out
            del out
            give_back()
        trim()

    return lean_run
