"""Numpy kernels that work on a whole Arrow batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BLOCK = 1 << 19
#: ASCII white space: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A to Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and len+1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def groups(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about ``most`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        out = []
        for base in (_PRIME, _INVERSE):
            x = np.full(size, base, U64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the white-space separated words of all rows."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~space[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = word[edge]
    stops = word.copy()
    stops[:-1] &= ~word[1:]
    stops[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes: prefix sums of a polynomial modulo 2^64."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + _BLOCK, "right")))
        stop = int(ends[i:j].max())
        power, inverse = _power_tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, U64)
        np.cumsum((raw[base:stop].astype(U64) + U64(1)) * power[: stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        h = (sums[e] - sums[s]) * inverse[s]
        out[i:j] = mix(h + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def run_ranks(sorted_keys: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal neighbours."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(first, at, 0))


class HashTable:
    """64-bit keys to row numbers by open addressing, filled and probed as whole arrays."""

    def __init__(self, keys: np.ndarray = np.zeros(0, U64), room: int = 0):
        self.n = 0
        self._reset(max(room, len(keys), 8))
        self.add(keys)

    def _reset(self, room: int) -> None:
        self.bits = int(4 * room - 1).bit_length()
        self.slot_key = np.zeros(1 << self.bits, U64)
        self.slot_row = np.full(1 << self.bits, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0xA24BAED4963EE407)) >> U64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Append distinct keys that aren't in the table yet; they get the next row numbers."""
        if (self.n + len(keys)) * 2 > len(self.slot_key):
            used = self.slot_row >= 0
            old, rows = self.slot_key[used], self.slot_row[used]
            self._reset(2 * (self.n + len(keys)))
            self._place(old, rows)
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        at, last = self._home(keys), len(self.slot_key) - 1
        while len(keys):
            free = self.slot_row[at] < 0
            self.slot_row[at[free]] = rows[free]
            self.slot_key[at[free]] = keys[free]
            # where two keys wanted one slot the later write stands
            again = self.slot_row[at] != rows
            won = free & ~again
            self.slot_key[at[won]] = keys[won]
            keys, rows, at = keys[again], rows[again], (at[again] + 1) & last

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not self.n or not len(keys):
            return out
        at, last = self._home(keys), len(self.slot_key) - 1
        rows = self.slot_row[at]
        hit = self.slot_key[at] == keys
        np.copyto(out, rows, where=hit & (rows >= 0))
        todo = np.flatnonzero(~hit & (rows >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & last
            rows = self.slot_row[at]
            hit = (self.slot_key[at] == keys[todo]) & (rows >= 0)
            out[todo[hit]] = rows[hit]
            more = ~hit & (rows >= 0)
            todo, at = todo[more], at[more]
        return out


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices pool[start[i] : start[i] + length[i]], end to end."""
    total = int(length.sum())
    if not total:
        return pool[:0].copy()
    before = np.cumsum(length) - length
    return pool[np.arange(total) + np.repeat(start - before, length)]


def binary_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of counts[i] items each as Arrow binary values."""
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.asarray(counts, np.int64) * flat.itemsize, out=ends[1:])
    flat = np.ascontiguousarray(flat)
    whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return whole.cast(pa.binary())


def binary_rows(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The items of all binary values end to end, and the count in each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw).view(dtype), np.diff(offs) // np.dtype(dtype).itemsize
